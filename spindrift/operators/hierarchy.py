"""Ward's hierarchy of whole tables (K05): reciprocal nearest neighbours merged in bulk rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .density import labelled, points_of
from .graph import components, saved
from .neighbours import PIECE, PIVOTS, Pivots, gaps, grid, in_units, matrix
from .relational import id_order

LAST = 8192
CELL = 8192


def costs(size_a: np.ndarray, size_b: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """What a merge adds to the sum of squares; by centroids, which is what the Lance-Williams update of Ward's distances comes to."""
    return size_a[:, None] * size_b[None] / (size_a[:, None] + size_b[None]) * gap * gap


def _partners(rows: np.ndarray, ids: np.ndarray, size: np.ndarray, x: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Of some rows their cheapest partners among all, of ties the smallest id, and the costs."""
    order = np.argsort(ids, kind="stable")
    near, cost = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
    for begin in range(0, len(rows) if len(ids) > 1 else 0, block):
        own = rows[begin : begin + block]
        c = costs(size[own], size[order], gaps(x[own], x[order]))
        c[own[:, None] == order[None]] = np.inf
        best = c.argmin(1)
        near[begin : begin + block], cost[begin : begin + block] = order[best], c[np.arange(len(own)), best]
    return near, cost


def _merge_all(ids: np.ndarray, size: np.ndarray, x: np.ndarray, limit: np.ndarray | None = None) -> dict:
    """All merges of a bounded number of clusters, in rounds of reciprocal nearest neighbours; with limits those that cost no more than either limit.

    A cluster keeps its partner until that merges, as no merge brings forth a cheaper one.
    """
    a_out, b_out, h_out, r_out, turn = [], [], [], [], 0
    limits = np.full(len(ids), np.inf) if limit is None else limit.copy()
    near, cost = _partners(np.arange(len(ids)), ids, size, x)
    while len(ids) > 1:
        own = np.arange(len(ids))
        i = np.flatnonzero((near[near] == own) & (ids < ids[near]) & (cost <= limits) & (cost <= limits[near]))
        j = near[i]
        if not len(i):
            if limit is not None:
                break
            i = np.array([cost.argmin()])  # a circle of ties
            j = near[i]
            i, j = (i, j) if ids[i[0]] < ids[j[0]] else (j, i)
        turn += 1
        a_out.append(ids[i]), b_out.append(ids[j]), h_out.append(cost[i]), r_out.append(np.full(len(i), turn))
        total = size[i] + size[j]
        x[i] = (size[i, None] * x[i] + size[j, None] * x[j]) / total[:, None]
        size[i], limits[i] = total, np.minimum(limits[i], limits[j])
        stay, merged = np.ones(len(ids), bool), np.zeros(len(ids), bool)
        stay[j], merged[i], merged[j] = False, True, True
        stale = (merged | merged[near])[stay]
        near = (np.cumsum(stay) - 1)[near][stay]
        ids, size, x, limits, cost = ids[stay], size[stay], x[stay], limits[stay], cost[stay]
        rows = np.flatnonzero(stale)
        near[rows], cost[rows] = _partners(rows, ids, size, x)
    none = np.zeros(0, np.int64)
    found = {n: np.concatenate(v) if v else none for n, v in (("a", a_out), ("b", b_out), ("height", h_out), ("round", r_out))}
    return found | {"left": (ids, size, x)}


def nearest_clusters(clusters: DataFrame, pivots: int = PIVOTS, piece: int = PIECE) -> DataFrame:
    """_id, _other, _cost: the cheapest partner of each cluster (_id, _size, _x), of ties the smallest id. Exact.

    A cluster's own piece and the pivots, which are clusters too, bound its cost from above; a cell by its radius and its smallest cluster from
    below, as the cost rises with either size and with the distance.
    """
    heads = Pivots(clusters, pivots)
    placed = saved(heads.placed(clusters.select("_id", "_size", "_x")), "placed")
    cells = heads.measured(placed, F.min("_size").alias("small"))
    order = np.array(sorted(cells))
    radius, small = (np.array([cells[c][k] for c in order.tolist()], float) for k in ("radius", "small"))
    sizes = {r["_id"]: r["_size"] for r in placed.filter(F.col("_id").isin(heads.ids.tolist())).select("_id", "_size").collect()}  # one row a pivot
    head_size = np.array([sizes[i] for i in heads.ids.tolist()], float)
    head_x, head_ids = heads.x, heads.ids

    def visits(batches):
        for batch in batches:
            if not len(batch):
                continue
            ids, size = batch.column("_id").to_numpy(), batch.column("_size").to_numpy()
            x = matrix(batch.column("_x"))
            d = gaps(x, head_x)
            to_heads = costs(size, head_size, d)
            to_heads[ids[:, None] == head_ids[None]] = np.inf
            limit = to_heads.min(1)
            for begin in range(0, len(ids), 1024):  # its own piece of the table
                own = slice(begin, begin + 1024)
                c = costs(size[own], size[own], gaps(x[own], x[own]))
                np.fill_diagonal(c, np.inf)
                limit[own] = np.minimum(limit[own], c.min(1))
            limit *= 1 + 1e-9
            low = costs(size, small, np.maximum(d[:, order] - radius[None], 0))
            i, j = np.nonzero(low <= limit[:, None])
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(pa.array(i)) for n in ("_id", "_size", "_x")), pa.array(order[j]), pa.array(limit[i])], ["_id", "_size", "_x", "_cell", "_limit"])

    left = saved(placed.select("_id", "_size", "_x").mapInArrow(visits, "_id long, _size double, _x array<double>, _cell long, _limit double"), "visits")
    right = placed.select("_id", "_size", "_x", "_cell", F.lit(0.0).alias("_limit"))

    def nearest(left: pa.Table, right: pa.Table):
        a, b = left.column("_id").to_numpy(), right.column("_id").to_numpy()
        c = costs(left.column("_size").to_numpy(), right.column("_size").to_numpy(), gaps(matrix(left.column("_x")), matrix(right.column("_x"))))
        c[(a[:, None] == b[None]) | (c > left.column("_limit").to_numpy()[:, None])] = np.inf
        by = np.argsort(b, kind="stable")
        best = by[c[:, by].argmin(1)]
        cost = c[np.arange(len(a)), best]
        keep = np.isfinite(cost)
        return {"_id": a[keep], "_other": b[best[keep]], "_cost": cost[keep]}

    found = in_units(grid(left, right, "_cell", "_id", piece), "_cell", nearest, "_id long, _other long, _cost double")
    return found.groupBy("_id").agg(F.min(F.struct("_cost", "_other")).alias("_best")).select("_id", "_best._other", "_best._cost")


class Boxes:
    """Cells of about `rows` clusters: halves of halves along rotated axes, cut at the medians of a bounded sample."""

    def __init__(self, sample: np.ndarray, n: int, rows: int, turn: int):
        self.turn = np.linalg.qr(np.random.default_rng(turn).normal(size=(sample.shape[1],) * 2))[0]  # other borders in each round
        self.cuts: list[tuple] = []
        self.cells = 0
        self._split(sample @ self.turn, n, rows)

    def _split(self, sample: np.ndarray, n: float, rows: int) -> int:
        """The number of the node that these make; below 0: a cell."""
        axis = int((sample.max(0) - sample.min(0)).argmax()) if len(sample) > 1 else 0
        cut = float(np.median(sample[:, axis])) if len(sample) > 1 else 0.0
        low = sample[:, axis] <= cut if len(sample) > 1 else np.zeros(0, bool)
        if n <= rows or len(sample) < 8 or low.all() or not low.any():
            self.cells += 1
            return -self.cells
        node = len(self.cuts)
        self.cuts.append(())
        self.cuts[node] = axis, cut, self._split(sample[low], n / 2, rows), self._split(sample[~low], n / 2, rows)
        return node

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        open_ = [(0 if self.cuts else -1, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                axis, cut, low, high = self.cuts[node]
                below = x[rows, axis] <= cut
                open_ += [(low, rows[below]), (high, rows[~below])]
        return out


def contracted(clusters: DataFrame, n: int, turn: int, rows: int = CELL, piece: int = PIECE, wide: float = 4.0) -> DataFrame:
    """_id, _size, _x of what is left after many merges, and a, b, height, round of these merges (_id null).

    Cells of the space merge their clusters each in its task, as long as a pair is reciprocally cheapest, costs no more than a common height and
    no more than either's cheapest partner in any other cell. By other merges no partner becomes cheaper than both that made it were, so what
    other cells do meanwhile changes nothing, and a merged cluster's bound is the smaller of two.
    """
    picked = clusters.orderBy(id_order("_id", turn), "_id").select("_id", "_size", "_x").limit(min(65_536, max(256, 32 * n // rows))).toArrow()
    boxes = Boxes(matrix(picked.column("_x")), n, rows, turn)
    heads = picked.slice(0, 256)
    head_ids, head_size, head_x = heads.column("_id").to_numpy(), heads.column("_size").to_numpy(), matrix(heads.column("_x"))

    def placing(batches):
        for batch in batches:
            x = matrix(batch.column("_x"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(boxes.cell_of(x @ boxes.turn) if len(x) else np.zeros(0, np.int64))], ["_id", "_size", "_x", "_cell"])

    def cheapest(batches):
        best = np.full(len(head_ids), np.inf)
        for batch in batches:
            if len(batch):
                c = costs(head_size, batch.column("_size").to_numpy(), gaps(head_x, matrix(batch.column("_x"))))
                c[head_ids[:, None] == batch.column("_id").to_numpy()[None]] = np.inf
                best = np.minimum(best, c.min(1))
        yield pa.RecordBatch.from_arrays([pa.array(head_ids), pa.array(best)], ["_id", "_cost"])

    def corners(batches):
        found: dict = {}
        for batch in batches:
            x, size, cell = matrix(batch.column("_x")), batch.column("_size").to_numpy(), batch.column("_cell").to_numpy()
            x = x @ boxes.turn if len(x) else x
            for c in np.unique(cell).tolist():
                own = cell == c
                new = np.r_[x[own].min(0), -x[own].max(0), size[own].min()]
                found[c] = np.minimum(found[c], new) if c in found else new
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], ["_cell", "_corner"])

    placed = saved(clusters.select("_id", "_size", "_x").mapInArrow(placing, "_id long, _size double, _x array<double>, _cell long"), "placed")
    costs_of = [r[0] for r in clusters.mapInArrow(cheapest, "_id long, _cost double").groupBy("_id").agg(F.min("_cost")).select("min(_cost)").collect()]  # a row a head
    height = wide * float(np.median(costs_of))
    width = head_x.shape[1] * 2 + 1
    edge = placed.mapInArrow(corners, "_cell long, _corner array<double>").groupBy("_cell").agg(*[F.min(F.get("_corner", F.lit(i))) for i in range(width)]).collect()  # a row a cell
    order = np.array([r[0] for r in edge])
    corner = np.array([list(r[1:]) for r in edge])
    low, high, small = corner[:, : width // 2], -corner[:, width // 2 : -1], corner[:, -1]

    def visits(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, size = matrix(batch.column("_x")) @ boxes.turn, batch.column("_size").to_numpy()
            gap = np.zeros((len(x), len(order)))
            for k in range(x.shape[1]):
                gap += np.maximum(np.maximum(low[None, :, k] - x[:, k, None], x[:, k, None] - high[None, :, k]), 0) ** 2
            least = costs(size, small, np.sqrt(gap)) * (1 - 1e-9) - 1e-12
            i, j = np.nonzero((least <= height) & (batch.column("_cell").to_numpy()[:, None] != order[None]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(pa.array(i)) for n in ("_id", "_size", "_x")), pa.array(order[j])], ["_id", "_size", "_x", "_cell"])

    left = placed.mapInArrow(visits, "_id long, _size double, _x array<double>, _cell long")

    def foreign(left: pa.Table, right: pa.Table):
        size, x, other, y = left.column("_size").to_numpy(), matrix(left.column("_x")), right.column("_size").to_numpy(), matrix(right.column("_x"))
        if not len(x) or not len(y):
            return None
        best = np.full(len(x), np.inf)
        near = Boxes(y[:: max(1, len(y) // 4096)], len(y), 128, turn)  # smaller boxes, of which a row meets those that may hold a cheap partner
        place = near.cell_of(y @ near.turn)
        u, v = x @ near.turn, y @ near.turn
        for cell in np.unique(place).tolist():
            own = place == cell
            far = np.maximum(np.maximum(v[own].min(0) - u, u - v[own].max(0)), 0)
            least = costs(size, other[own].min(keepdims=True), np.sqrt((far * far).sum(1))[:, None])[:, 0] * (1 - 1e-9) - 1e-12
            rows = np.flatnonzero(least <= np.minimum(best, height))
            if len(rows):
                best[rows] = np.minimum(best[rows], costs(size[rows], other[own], gaps(x[rows], y[own])).min(1))
        return {"_id": left.column("_id").to_numpy(), "_bound": best}

    bounds = in_units(grid(saved(left, "visits"), placed, "_cell", "_id", piece), "_cell", foreign, "_id long, _bound double").groupBy("_id").agg(F.min("_bound").alias("_bound"))
    limited = placed.join(bounds, "_id", "left").select("_id", "_size", "_x", "_cell", F.least(F.coalesce("_bound", F.lit(height)), F.lit(height)).alias("_limit"))

    def merging(table: pa.Table) -> pa.Table:
        found = _merge_all(table.column("_id").to_numpy().copy(), table.column("_size").to_numpy().copy(), matrix(table.column("_x")).copy(), table.column("_limit").to_numpy())
        ids, size, x = found["left"]
        m = len(found["a"])
        null = lambda k, kind: pa.nulls(k, kind)
        rows = pa.array(x.tolist(), pa.list_(pa.float64()))
        ends = [(ids, "_id", pa.int64()), (size, "_size", pa.float64())]
        columns = {name: pa.concat_arrays([pa.array(v, kind), null(m, kind)]) for v, name, kind in ends} | {"_x": pa.concat_arrays([rows, null(m, rows.type)])}
        for name, kind in (("a", pa.int64()), ("b", pa.int64()), ("height", pa.float64()), ("round", pa.int64())):
            values = found[name] + turn * 1_000_000 if name == "round" else found[name]
            columns[name] = pa.concat_arrays([null(len(ids), kind), pa.array(values, kind)])
        return pa.table(columns)

    return saved(limited.groupBy("_cell").applyInArrow(merging, "_id long, _size double, _x array<double>, a long, b long, height double, round long"), "contracted")


def ward_merges(points: DataFrame, last: int = LAST, pivots: int = PIVOTS, piece: int = PIECE, cell: int = CELL) -> DataFrame:
    """a, b, height, round: all merges of the hierarchy over points (_id, _x), each cluster named by its smallest id.

    In a round every pair of clusters that are each other's cheapest partner merges; Ward's cost never falls below that of such a pair by other merges,
    so the hierarchy is that of merging one pair at a time. Cells of the space merge what they can by themselves (contracted), rounds over all pairs take
    over when that gives too little. The last LAST clusters, however many rows there were, are merged in one task. Equal points are one cluster from the start.
    """
    clusters = saved(points.groupBy("_x").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).cast("double").alias("_size")).select("_id", "_size", "_x"), "clusters")
    merges, turn, n = None, 0, clusters.count()
    if not (same := clusters.filter("_size > 1")).isEmpty():
        merges = points.select(F.col("_id").alias("b"), "_x").join(same.select(F.col("_id").alias("a"), "_x"), "_x").filter("a <> b")
        merges = saved(merges.select("a", "b", F.lit(0.0).alias("height"), F.lit(0).cast("long").alias("round")), "pairs")

    def final(table: pa.Table) -> pa.Table:
        found = _merge_all(table.column("_id").to_numpy().copy(), table.column("_size").to_numpy().copy(), matrix(table.column("_x")).copy())
        return pa.table({"a": pa.array(found["a"], pa.int64()), "b": pa.array(found["b"], pa.int64()), "height": pa.array(found["height"], pa.float64()), "round": pa.array(found["round"] + (turn + 1) * 1_000_000, pa.int64())})

    while n > last:
        turn += 1
        kept = contracted(clusters, n, turn, cell, piece)
        pairs = kept.filter("_id is null").select("a", "b", "height", "round")
        if (fewer := n - pairs.count()) < 0.95 * n:
            merges = pairs if merges is None else merges.unionByName(pairs)
            clusters, n = kept.filter("_id is not null").select("_id", "_size", "_x"), fewer
            continue
        near = saved(nearest_clusters(clusters, pivots, piece), "nearest")
        back = near.select(F.col("_id").alias("_other"), F.col("_other").alias("_id"))
        pairs = near.join(back, ["_id", "_other"]).filter("_id < _other")
        pairs = saved(pairs.select(F.col("_id").alias("a"), F.col("_other").alias("b"), F.col("_cost").alias("height"), F.lit(turn * 1_000_000).cast("long").alias("round")), "pairs")
        if pairs.isEmpty():  # a circle of ties: the cheapest pair alone
            first = near.orderBy("_cost", F.least("_id", "_other"), F.greatest("_id", "_other")).limit(1)
            pairs = saved(first.select(F.least("_id", "_other").alias("a"), F.greatest("_id", "_other").alias("b"), F.col("_cost").alias("height"), F.lit(turn * 1_000_000).cast("long").alias("round")), "pairs")
        merges = pairs if merges is None else merges.unionByName(pairs)
        gone = clusters.join(pairs.select(F.col("b").alias("_id"), F.col("a").alias("_to")), "_id").select(F.col("_to").alias("_id"), F.col("_size").alias("_s"), F.col("_x").alias("_y"))
        rest = clusters.join(pairs.select(F.col("b").alias("_id")), "_id", "left_anti").join(gone, "_id", "left")
        both = F.col("_size") + F.col("_s")
        centre = F.zip_with("_x", "_y", lambda u, v: (F.col("_size") * u + F.col("_s") * v) / both)
        # under new names: within a lambda Spark takes a name for a column that the same select makes
        fresh = rest.select("_id", F.coalesce(both, "_size").alias("_total"), F.when(F.col("_s").isNotNull(), centre).otherwise(F.col("_x")).alias("_centre"))
        clusters = saved(fresh.withColumnsRenamed({"_total": "_size", "_centre": "_x"}), "clusters")
        n = clusters.count()
    end = clusters.groupBy(F.lit(0).alias("_all")).applyInArrow(final, "a long, b long, height double, round long")
    return saved(end if merges is None else merges.unionByName(end), "merges")


def ward_table(features: DataFrame, id_col: str, vec: str = "features", n_clusters: int = 2, first: int = 0, last: int = LAST, pivots: int = PIVOTS, piece: int = PIECE, cell: int = CELL) -> DataFrame:
    """(id, cluster_label), the labels of clustering.agglomerative for any number of rows: Ward's hierarchy without its n_clusters - 1 dearest merges.

    Labels are numbered by the smallest id of a cluster. Rows without a vector, or with a null or NaN in it, get -1; rows that repeat an id are one point, at
    the smallest of their vectors; with fewer rows than clusters each is its own; an empty table gives an empty result.
    """
    points = saved(points_of(features, id_col, vec).groupBy("_id").agg(F.min("_x").alias("_x")), "points")
    merges = ward_merges(points, last, pivots, piece, cell)
    dearest = merges.orderBy(F.desc("height"), F.desc("round"), "a").limit(max(0, n_clusters - 1))
    links = merges.join(F.broadcast(dearest.select("a", "b", "round")), ["a", "b", "round"], "left_anti")
    named = components(links).select(F.col("node").alias("_id"), F.col("component").alias("_cluster"))
    clusters = points.select("_id").join(named, "_id", "left").select("_id", F.coalesce("_cluster", "_id").alias("_cluster"))
    return labelled(features, id_col, saved(clusters, "named"), first)
