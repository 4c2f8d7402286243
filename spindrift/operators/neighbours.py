"""Near points of whole tables: groups of points by place, cut into units of bounded size; exact k-neighbours on pivots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import saved
from .relational import id_order

PIECE = 2048
PIVOTS = 256
TILE = 256


def matrix(column) -> np.ndarray:
    """A list column of equally long vectors as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a and b; the same number for a pair whichever comes first."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        diff = a[:, k, None] - b[None, :, k]
        out += diff * diff
    return np.sqrt(out)


def grid(left: DataFrame, right: DataFrame, key: str, by: str, piece: int = PIECE) -> DataFrame:
    """Rows of left (_left true) and right in units, so that each row of left meets each row of right of its key in just one unit.

    Keys of many rows are cut by a hash of `by` into pieces of left and blocks of right, and each piece goes to each block: no unit holds
    more than about `piece` rows of a side. Small keys are dealt into shared units. left and right have the same columns.
    """
    sides = left.withColumn("_left", F.lit(True)).unionByName(right.withColumn("_left", F.lit(False)))
    count = sides.groupBy(key).agg(F.count_if("_left").alias("_l"), F.count_if(~F.col("_left")).alias("_r")).filter("_l > 0 and _r > 0")
    count = saved(count, "keys")
    total = count.agg(F.sum(F.col("_l") + F.col("_r"))).first()[0] or 0
    sized = sides.join(count, key)
    cuts = {True: F.ceil(F.col("_l") / piece), False: F.ceil(F.col("_r") / piece)}
    own = F.pmod(F.xxhash64(by, F.lit(11)), F.when(F.col("_left"), cuts[True]).otherwise(cuts[False]))
    other = F.sequence(F.lit(0).cast("long"), F.when(F.col("_left"), cuts[False]).otherwise(cuts[True]) - 1)
    spread = sized.withColumn("_own", own).withColumn("_other", F.explode(other))
    small = (F.col("_l") <= piece) & (F.col("_r") <= piece)
    shared = F.pmod(F.xxhash64(key), F.lit(max(1, total // piece)))
    place = F.xxhash64(key, F.when(F.col("_left"), F.col("_own")).otherwise(F.col("_other")), F.when(F.col("_left"), F.col("_other")).otherwise(F.col("_own")))
    return spread.withColumn("_unit", F.when(small, shared).otherwise(place)).drop("_l", "_r", "_own", "_other")


def in_units(units: DataFrame, key: str, kernel: Callable[[pa.Table, pa.Table], Iterator[dict] | dict | None], schema: str) -> DataFrame:
    """kernel(left rows, right rows) of each key in each unit; it gives columns of equal length."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        keys = table.column(key).to_numpy(zero_copy_only=False)
        is_left = table.column("_left").to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        out: list[list[np.ndarray]] = [[] for _ in names]
        for rows in np.split(order, starts[1:]):
            found = kernel(table.take(rows[is_left[rows]]), table.take(rows[~is_left[rows]]))
            if found:
                for column, name in zip(out, names, strict=True):
                    column.append(found[name])
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0), kinds[n]) for c, n in zip(out, names, strict=True)], names)

    kinds = {n: pa.int64() if c.endswith("long") else pa.float64() for n, c in zip(names, schema.split(", "), strict=True)}
    return units.groupBy("_unit").applyInArrow(run, schema)


class Pivots:
    """A bounded sample of points; every point belongs to the cell of its nearest pivot."""

    def __init__(self, points: DataFrame, n: int = PIVOTS):
        rows = points.orderBy(id_order("_id"), "_id").select("_id", "_x").limit(n).toArrow()  # n of them at most
        self.ids, self.x = rows.column("_id").to_numpy(), matrix(rows.column("_x"))

    def placed(self, points: DataFrame) -> DataFrame:
        """points with _cell, and _far from its pivot."""
        pivots, names = self.x, points.columns

        def run(batches):
            for batch in batches:
                d = gaps(matrix(batch.column("_x")), pivots) if len(batch) else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1), pa.int64()), pa.array(d.min(1), pa.float64())], [*names, "_cell", "_far"])

        schema = ", ".join([*(f"`{c}` {t}" for c, t in points.dtypes), "_cell long", "_far double"])
        return points.mapInArrow(run, schema)

    def measured(self, placed: DataFrame, *more: Column) -> dict[int, dict]:
        """Of each cell its radius and rows, and more: one row a pivot comes to the driver."""
        found = placed.groupBy("_cell").agg(F.max("_far").alias("radius"), F.count(F.lit(1)).alias("rows"), *more).collect()
        return {r["_cell"]: r.asDict() for r in found}


def k_nearest(points: DataFrame, k: int, pivots: Pivots, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(_id, _x, _cell, _far, _core) and (_id, _other, _d): each point's distance to its k-th nearest other point, and these k points. points: _id, _x.

    The k nearest rows of a point's own piece bound the distance from above, as do cells by their radius and number of rows; only cells that may hold
    a nearer point are searched, so the result is exact. Ties go to the smaller id.
    """
    placed = saved(pivots.placed(points.select("_id", "_x")), "placed")
    cells = pivots.measured(placed)
    order = np.array(sorted(cells))
    radius, rows = (np.array([cells[c][name] for c in order.tolist()], float) for name in ("radius", "rows"))
    total = int(rows.sum())
    k = min(k, total - 1)
    if k < 1:
        return placed.select("_id", "_x", "_cell", "_far", F.lit(0.0).alias("_core")), placed.select("_id", F.col("_id").alias("_other"), F.lit(0.0).alias("_d")).limit(0)
    heads = pivots.x[order]

    def reach(left: pa.Table, right: pa.Table):
        x = matrix(left.column("_x"))
        near = [np.partition(gaps(x[i : i + TILE], x), k, axis=1)[:, k] for i in range(0, len(x), TILE)] if len(x) > k else [np.full(len(x), np.inf)]
        bound = np.concatenate(near)
        return {"_id": left.column("_id").to_numpy(), "_cell": left.column("_cell").to_numpy(), "_bound": bound}

    # one unit a piece: a piece is compared with itself only
    pieces = placed.withColumn("_key", F.col("_cell") * 1_000_000 + F.pmod(F.xxhash64("_id"), F.lit(max(1, int(rows.max()) // piece + 1)))) if rows.max() > piece else placed.withColumn("_key", F.col("_cell"))
    alone = pieces.withColumn("_left", F.lit(True)).withColumn("_unit", F.pmod(F.xxhash64("_key"), F.lit(max(1, total // piece))))
    bounds = in_units(alone, "_key", reach, "_id long, _cell long, _bound double")

    def visits(batches):
        for batch in batches:
            if not len(batch):
                continue
            d = gaps(matrix(batch.column("_x")), heads)
            by = np.argsort(d + radius, axis=1)
            enough = (np.cumsum(rows[by], axis=1) > k).argmax(1)
            wide = np.take_along_axis(d + radius, by, axis=1)[np.arange(len(d)), enough]
            limit = np.minimum(batch.column("_bound").to_numpy(), wide) * (1 + 1e-9)
            i, j = np.nonzero(d - radius <= limit[:, None])
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(i)), batch.column("_x").take(pa.array(i)), pa.array(order[j]), pa.array(limit[i])], ["_id", "_x", "_cell", "_limit"])

    limited = placed.join(bounds.select("_id", "_bound"), "_id").select("_id", "_x", "_bound")
    left = saved(limited.mapInArrow(visits, "_id long, _x array<double>, _cell long, _limit double"), "visits")
    right = placed.select("_id", "_x", "_cell", F.lit(0.0).alias("_limit"))

    def nearest(left: pa.Table, right: pa.Table):
        a, b = left.column("_id").to_numpy(), right.column("_id").to_numpy()
        by = np.argsort(b)
        x, y, b, limit, parts = matrix(left.column("_x")), matrix(right.column("_x"))[by], b[by], left.column("_limit").to_numpy(), []
        for begin in range(0, len(a) if len(b) else 0, TILE):
            rows = slice(begin, begin + TILE)
            d = gaps(x[rows], y)
            d[a[rows, None] == b[None]] = np.inf
            d[d > limit[rows, None]] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :k]  # of equal distances the smallest id
            near = np.take_along_axis(d, best, axis=1)
            i, j = np.nonzero(np.isfinite(near))
            parts.append((a[rows][i], b[best[i, j]], near[i, j]))
        return {n: np.concatenate(v) for n, v in zip(("_id", "_other", "_d"), zip(*parts, strict=True), strict=True)} if parts else None

    found = in_units(grid(left, right, "_cell", "_id", piece), "_cell", nearest, "_id long, _other long, _d double")
    # at most k rows of each block that a point has visited
    lists = found.groupBy("_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("_d", "_other"))), 1, k).alias("_near"))
    lists = saved(lists, "nearest")
    cores = placed.join(lists.select("_id", F.element_at("_near", k)["_d"].alias("_core")), "_id").select("_id", "_x", "_cell", "_far", "_core")
    return saved(cores, "cores"), lists.select("_id", F.explode("_near").alias("_n")).select("_id", F.col("_n._other").alias("_other"), F.col("_n._d").alias("_d"))
