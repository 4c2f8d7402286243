"""Mean shift of whole tables (K10): seeds from a grid of bins climb in rounds, their nearest mode gives the points their cluster."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .density import GRID_DIMENSIONS, labelled, points_of
from .graph import saved
from .neighbours import PIECE, PIVOTS, Pivots, gaps, grid, in_units, matrix
from .relational import id_order

SAMPLE = 1000


def estimated_bandwidth(points: DataFrame, share: float = 0.3, sample: int = SAMPLE) -> float:
    """The mean distance to the neighbour that has a share of all points within it, on at most `sample` points."""
    x = matrix(points.orderBy(id_order("_id"), "_id").select("_x").limit(sample).toArrow().column("_x"))
    if not len(x):
        return 1.0
    k = max(1, int(len(x) * share)) - 1
    return float(np.partition(gaps(x, x), k, axis=1)[:, k].mean()) or 1.0


def _cells(rows: DataFrame, at: str, side: float, g: int, spread: bool) -> DataFrame:
    """rows with _cell, on a grid of this side over the first g dimensions; spread: a copy for each cell within a side of the row."""
    place = [F.floor(F.col(at)[i] / side) for i in range(g)]

    def name(offset):
        return F.concat_ws(",", *[(place[i] + o).cast("string") for i, o in enumerate(offset)])

    if not spread:
        return rows.withColumn("_cell", name((0,) * g))

    def gap(i: int, o: int):
        x, low = F.col(at)[i], place[i] * side
        return F.lit(0.0) if o == 0 else x - low if o < 0 else low + side - x

    cells = [F.when(sum((gap(i, o) * gap(i, o) for i, o in enumerate(offset)), F.lit(0.0)) <= side * side * (1 + 1e-9), name(offset)) for offset in itertools.product((-1, 0, 1), repeat=g)]
    return rows.withColumn("_cell", F.explode(F.array_compact(F.array(*cells))))


def climbed(points: DataFrame, seeds: DataFrame, bandwidth: float, d: int, rounds: int = 300, piece: int = PIECE) -> DataFrame:
    """_seed, _x, _n: the modes that seeds (_seed, _x) reach, with the points within the bandwidth of them. points: _id, _x.

    A round sums up the points around each seed: points are keyed by grid cells of side bandwidth, seeds go to the cells within it, and units
    of bounded size add up counts and sums. Seeds that have met go on as one, those that move by less than a thousandth of the bandwidth are modes.
    """
    g = min(d, GRID_DIMENSIONS)
    parts = [f"_s{i}" for i in range(d)]
    fixed = saved(_cells(points.select("_id", "_x"), "_x", bandwidth, g, spread=False), "cells")

    def around(left: pa.Table, right: pa.Table):
        x = matrix(right.column("_x"))
        near = (gaps(matrix(left.column("_x")), x) <= bandwidth).astype(float)
        return {"_id": left.column("_id").to_numpy(), "_n": near.sum(1).astype(np.int64), **dict(zip(parts, (near @ x).T, strict=True))}

    schema = ", ".join(["_id long", "_n long", *(f"{p} double" for p in parts)])
    moving, done = saved(seeds.select(F.col("_seed").alias("_id"), "_x"), "seeds"), None
    for turn in range(rounds):
        found = in_units(grid(_cells(moving, "_x", bandwidth, g, spread=True), fixed, "_cell", "_id", piece), "_cell", around, schema)
        sums = found.groupBy("_id").agg(F.sum("_n").alias("_n"), *[F.sum(p).alias(p) for p in parts]).filter("_n > 0")
        means = sums.select("_id", "_n", F.array(*[F.col(p) / F.col("_n") for p in parts]).alias("_to")).join(moving, "_id")
        shift = F.sqrt(F.aggregate(F.zip_with("_to", "_x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
        step = saved(means.select("_id", "_n", "_to", (shift < 1e-3 * bandwidth).alias("_still")), "steps")
        # seeds that are at one place, but for rounding, go on as one
        spot = F.transform("_to", lambda v: F.rint(v / (1e-6 * bandwidth)))
        met = step.groupBy(spot.alias("_spot"), "_still").agg(F.min_by(F.struct("_id", "_to", "_n"), "_id").alias("_r")).select("_r.*", "_still")
        still = met.filter("_still").select(F.col("_id").alias("_seed"), F.col("_to").alias("_x"), "_n")
        done = still if done is None else done.unionByName(still)
        moving = saved(met.filter("not _still").select("_id", F.col("_to").alias("_x")), "seeds")
        if moving.isEmpty():
            break
        if turn % 8 == 7:
            done = saved(done, "modes")
    return saved(done, "modes")


def separated(modes: DataFrame, bandwidth: float, d: int, piece: int = PIECE) -> DataFrame:
    """The modes (_seed, _x, _n) that have no kept one of more points, or of as many and larger coordinates, within the bandwidth.

    In a round the modes that come first among the undecided ones around them are kept, and drop these.
    """
    g = min(d, GRID_DIMENSIONS)
    rows = modes.select(F.col("_seed").alias("_id"), "_x", "_n")

    def before(left: pa.Table, right: pa.Table):
        (a, n), (b, m) = ((t.column("_id").to_numpy(), t.column("_n").to_numpy()) for t in (left, right))
        x, y = matrix(left.column("_x")), matrix(right.column("_x"))
        first, tied = m[None] > n[:, None], m[None] == n[:, None]
        for u, v in (*zip(x.T, y.T, strict=True), (-a, -b)):
            first |= tied & (v[None] > u[:, None])
            tied &= v[None] == u[:, None]
        i, j = np.nonzero((gaps(x, y) <= bandwidth) & first)
        return {"_id": a[i], "_before": b[j]}

    pairs = saved(in_units(grid(_cells(rows, "_x", bandwidth, g, spread=True), _cells(rows, "_x", bandwidth, g, spread=False), "_cell", "_id", piece), "_cell", before, "_id long, _before long"), "pairs")
    open_, kept = saved(rows.select("_id"), "open"), None
    while not open_.isEmpty():
        live = pairs.join(open_, "_id").join(open_.select(F.col("_id").alias("_before")), "_before")
        first = saved(open_.join(live.select("_id").distinct(), "_id", "left_anti"), "first")
        kept = first if kept is None else kept.unionByName(first)
        dropped = pairs.join(first.select(F.col("_id").alias("_before")), "_before").select("_id").distinct()
        open_ = saved(open_.join(first, "_id", "left_anti").join(dropped, "_id", "left_anti"), "open")
    return modes.join(kept.select(F.col("_id").alias("_seed")), "_seed") if kept is not None else modes


def nearest_mode(points: DataFrame, modes: DataFrame, pivots: int = PIVOTS, piece: int = PIECE) -> DataFrame:
    """_id, _mode (its _seed) of each point; of ties the smaller seed. Pivots among the modes bound the distance; cells that may hold a nearer mode are searched."""
    heads = Pivots(modes.select(F.col("_seed").alias("_id"), "_x"), pivots)
    placed = saved(heads.placed(modes.select(F.col("_seed").alias("_id"), "_x")), "modes")
    cells = heads.measured(placed)
    order = np.array(sorted(cells))
    radius, head_x = np.array([cells[c]["radius"] for c in order.tolist()]), heads.x[order]

    def visits(batches):
        for batch in batches:
            d = gaps(matrix(batch.column("_x")), head_x) if len(batch) else np.zeros((0, len(order)))
            i, j = np.nonzero(d - radius <= d.min(axis=1, initial=np.inf)[:, None] * (1 + 1e-9))
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(pa.array(i)) for n in ("_id", "_x")), pa.array(order[j], pa.int64())], ["_id", "_x", "_cell"])

    def nearest(left: pa.Table, right: pa.Table):
        b = right.column("_id").to_numpy()
        by = np.argsort(b, kind="stable")
        d = gaps(matrix(left.column("_x")), matrix(right.column("_x")))[:, by]
        at = d.argmin(1)
        return {"_id": left.column("_id").to_numpy(), "_mode": b[by[at]], "_d": d[np.arange(len(d)), at]}

    left = saved(points.select("_id", "_x").mapInArrow(visits, "_id long, _x array<double>, _cell long"), "visits")
    found = in_units(grid(left, placed.select("_id", "_x", "_cell"), "_cell", "_id", piece), "_cell", nearest, "_id long, _mode long, _d double")
    return found.groupBy("_id").agg(F.min(F.struct("_d", "_mode")).alias("_best")).select("_id", "_best._mode")


def mean_shift_table(features: DataFrame, id_col: str, vec: str = "features", bandwidth: float | None = None, rounds: int = 300, first: int = 0, piece: int = PIECE) -> DataFrame:
    """(id, cluster_label): the clusters of clustering.meanshift for any number of rows, numbered by their smallest id.

    bandwidth: None estimates it on at most SAMPLE rows. Rows without a vector, or with a null or NaN in it, get -1; rows that repeat an id are one point, at the smallest
    of their vectors; an empty table gives an empty result.
    """
    points = saved(points_of(features, id_col, vec).groupBy("_id").agg(F.min("_x").alias("_x")), "points")
    head = points.select(F.size("_x")).first()
    if head is None:
        return features.select(id_col, F.lit(-1).cast("long").alias("cluster_label"))
    width = estimated_bandwidth(points) if bandwidth is None else bandwidth
    seeds = points.groupBy(F.transform("_x", lambda v: F.rint(v / width)).alias("_bin")).agg(F.min("_id").alias("_seed")).select("_seed", F.transform("_bin", lambda v: v * width).alias("_x"))
    modes = saved(separated(climbed(points, seeds, width, head[0], rounds, piece), width, head[0], piece), "kept")
    found = saved(nearest_mode(points, modes, piece=piece), "nearest")
    names = found.groupBy("_mode").agg(F.min("_id").alias("_cluster"))
    return labelled(features, id_col, saved(found.join(names, "_mode").select("_id", "_cluster"), "named"), first)
