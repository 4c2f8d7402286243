"""Density-based clusters of whole tables (K06): grid cells as join keys, core counts, components of core links. No bound on rows."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, forest, numbered, saved
from .neighbours import PIECE, gaps, grid, in_units, matrix

NOISE = -1
GRID_DIMENSIONS = 3


def points_of(features: DataFrame, id_col: str, vec: str) -> DataFrame:
    """_id and _x of the rows that have a vector without nulls."""
    rows = features.select(F.col(id_col).cast("long").alias("_id"), F.col(vec).cast("array<double>").alias("_x"))
    return rows.filter(F.col("_id").isNotNull() & (F.size("_x") > 0) & ~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))


def labelled(features: DataFrame, id_col: str, clusters: DataFrame, first: int = 0) -> DataFrame:
    """(id, cluster_label) for all rows of features; clusters: _id, _cluster (any numbers, null for noise). Labels follow the order of these numbers."""
    names = numbered(saved(clusters.filter("_cluster is not null").select("_cluster").distinct(), "names"), "_cluster", "_label")
    found = clusters.join(names, "_cluster").select(F.col("_id").alias(id_col), "_label")
    out = features.select(F.col(id_col)).join(found, id_col, "left")
    return out.select(id_col, F.coalesce(F.col("_label") + first, F.lit(NOISE)).cast("long").alias("cluster_label"))


def dbscan_table(features: DataFrame, id_col: str, vec: str = "features", eps: float = 3.0, min_samples: int = 5, first: int = 0, piece: int = PIECE) -> DataFrame:
    """(id, cluster_label), the labels of clustering.dbscan for any number of rows; -1 is noise.

    1. Points of one fine cell (diagonal eps) are all within eps of each other: where there are min_samples of them they are core
       points and one node, with no pair compared.
    2. Other points count their neighbours: points are keyed by cells of side eps on the first three dimensions, with copies for the
       neighbouring cells within eps; (cell, piece, block) units compare them.
    3. Core points within eps link their nodes: first the outermost few of each node, whose components are parts; then, only in cells that
       hold several parts, points of different parts. Each unit sends a forest, and the components of parts are the clusters.
    4. A border point goes to the cluster of the smallest core id among those within eps.

    Rows without a vector, or with a null or NaN in it, are noise. Rows that repeat an id are one point with several places. An empty table
    gives an empty result. Ties at eps count as near.
    """
    points = saved(points_of(features, id_col, vec), "points")
    d = points.agg(F.max(F.size("_x"))).first()[0] or 1
    fine = eps / math.sqrt(d) * (1 - 1e-9)
    keyed = points.withColumn("_fine", F.transform("_x", lambda v: F.floor(v / fine)))
    dense = keyed.groupBy("_fine").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_node")).filter(F.col("_n") >= min_samples)
    # AQE splits the skewed side of this join; dense has one row a cell
    known = keyed.join(dense, "_fine", "left").select("_id", "_x", F.coalesce("_node", "_id").alias("_node"), F.col("_n").isNotNull().alias("_sure"))
    g = min(d, GRID_DIMENSIONS)
    at = [F.floor(F.col("_x")[i] / eps) for i in range(g)]
    known = saved(known.withColumn("_at", F.array(*at)), "known")

    def cell(offset):
        return F.concat_ws(",", *[(F.col("_at")[i] + o).cast("string") for i, o in enumerate(offset)])

    def gap(i: int, o: int):
        x, low = F.col("_x")[i], F.col("_at")[i] * eps
        return F.lit(0.0) if o == 0 else x - low if o < 0 else low + eps - x

    def copies(rows: DataFrame) -> DataFrame:
        """rows for each cell of the grid that is within eps of them."""
        offsets = list(itertools.product((-1, 0, 1), repeat=g))
        cells = [F.when(sum((gap(i, o) * gap(i, o) for i, o in enumerate(offset)), F.lit(0.0)) <= eps * eps * (1 + 1e-9), cell(offset)) for offset in offsets]
        return rows.withColumn("_cell", F.explode(F.array_compact(F.array(*cells)))).drop("_at")

    def home(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_cell", cell((0,) * g)).drop("_at")

    def near(left: pa.Table, right: pa.Table) -> np.ndarray:
        return gaps(matrix(left.column("_x")), matrix(right.column("_x"))) <= eps

    def counted(left: pa.Table, right: pa.Table):
        return {"_id": left.column("_id").to_numpy(), "_near": near(left, right).sum(1)}

    slim = known.select("_id", "_x", "_at", "_sure")
    counts = in_units(grid(home(slim.filter("not _sure")).drop("_sure"), copies(slim).drop("_sure"), "_cell", "_id", piece), "_cell", counted, "_id long, _near long")
    cores = counts.groupBy("_id").agg(F.sum("_near").alias("_near")).filter(F.col("_near") >= min_samples).select("_id", F.lit(True).alias("_by_count"))
    judged = saved(known.join(cores, "_id", "left").select("_id", "_x", "_at", "_node", (F.col("_sure") | F.coalesce("_by_count", F.lit(False))).alias("_core")), "judged")

    def linked(left: pa.Table, right: pa.Table):
        a, b = left.column("_node").to_numpy(), right.column("_node").to_numpy()
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, m = a[by_a], b[by_b], near(left, right)[np.ix_(by_a, by_b)]
        at_a, at_b = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]), np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        i, j = np.nonzero(np.logical_or.reduceat(np.logical_or.reduceat(m, at_a, axis=0), at_b, axis=1))
        x, y = forest(a[at_a][i], b[at_b][j])
        return {"a": x, "b": y}

    core = judged.filter("_core").drop("_core")
    point = F.struct("_id", "_x", "_at")
    ends = F.array(*[f(point, F.col("_x")[i]) for i in range(g) for f in (F.min_by, F.max_by)])
    outer = saved(core.groupBy("_node").agg(F.array_distinct(ends).alias("_ends")).select("_node", F.explode("_ends").alias("_p")).select("_p.*", "_node"), "outer")
    parts = components(in_units(grid(home(outer), copies(outer), "_cell", "_id", piece), "_cell", linked, "a long, b long"))
    placed = core.join(parts.select(F.col("node").alias("_node"), "component"), "_node", "left")
    placed = saved(placed.select("_id", "_x", "_at", F.coalesce("component", "_node").alias("_part")), "parts")

    def crossed(left: pa.Table, right: pa.Table):
        a, b, found = left.column("_part").to_numpy(), right.column("_part").to_numpy(), [np.zeros((0, 2), np.int64)]
        own = np.unique(b)
        for p in np.array_split(own, min(len(own), 16)):  # pairs of one part are not compared, unless there are very many parts
            rows = np.flatnonzero(np.isin(b, p))
            others = np.flatnonzero(a != p[0]) if len(p) == 1 else np.arange(len(a))
            i, j = np.nonzero(near(left.take(others), right.take(rows))) if len(others) else ([], [])
            found.append(np.unique(np.c_[a[others[i]], b[rows[j]]], axis=0) if len(i) else found[0])
        x, y = forest(*np.concatenate(found).T)
        return {"a": x, "b": y}

    mixed = copies(placed).groupBy("_cell").agg(F.min("_part").alias("_low"), F.max("_part").alias("_high")).filter("_low < _high")
    mixed = saved(mixed.select("_cell"), "mixed")
    second = components(in_units(grid(home(placed).join(mixed, "_cell"), copies(placed).join(mixed, "_cell"), "_cell", "_id", piece), "_cell", crossed, "a long, b long"))
    named = placed.join(second.select(F.col("node").alias("_part"), "component"), "_part", "left").select("_id", "_x", "_at", F.coalesce("component", "_part").alias("_cluster"))
    named = saved(named, "cores")

    def bordering(left: pa.Table, right: pa.Table):
        cluster = right.column("_cluster").to_numpy()
        best = np.where(near(left, right), cluster[None], np.iinfo(np.int64).max).min(1)
        keep = best < np.iinfo(np.int64).max
        return {"_id": left.column("_id").to_numpy()[keep], "_cluster": best[keep]}

    others = judged.filter("not _core").select("_id", "_x", "_at", F.lit(0).cast("long").alias("_cluster"))
    borders = in_units(grid(home(others), copies(named), "_cell", "_id", piece), "_cell", bordering, "_id long, _cluster long")
    clusters = named.select("_id", "_cluster").unionByName(borders).groupBy("_id").agg(F.min("_cluster").alias("_cluster"))
    return labelled(features, id_col, saved(clusters, "clusters"), first)
