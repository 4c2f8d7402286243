"""HDBSCAN of whole tables (K07, K08): exact neighbours on pivots, a minimum spanning tree in Boruvka rounds, a condensed tree from its edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .density import labelled, points_of
from .graph import components, forest, saved
from .neighbours import PIECE, PIVOTS, Pivots, gaps, grid, in_units, k_nearest, matrix

BAND = 100_000
TILE = 256
_EDGE = "_own long, _w double, _lo long, _hi long, _c_lo long, _c_hi long"


def _least(own: np.ndarray, w: np.ndarray, p: np.ndarray, q: np.ndarray, cp: np.ndarray, cq: np.ndarray) -> dict:
    """For each component of own its edge that is least by (weight, smaller id, larger id)."""
    swap = p > q
    lo, hi, c_lo, c_hi = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, cq, cp), np.where(swap, cp, cq)
    order = np.lexsort((hi, lo, w, own))
    first = order[np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])] if len(own) else order
    return {n: v[first] for n, v in zip(("_own", "_w", "_lo", "_hi", "_c_lo", "_c_hi"), (own, w, lo, hi, c_lo, c_hi), strict=True)}


def _least_rows(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("_own").agg(F.min(F.struct("_w", "_lo", "_hi", "_c_lo", "_c_hi")).alias("_e"))
    return best.select("_own", "_e.*")


def spanning_tree(cores: DataFrame, near: DataFrame, pivots: Pivots, piece: int = PIECE) -> DataFrame:
    """_w, _lo, _hi: the minimum spanning tree of mutual reachability, max(core, core, distance). cores: _id, _x, _cell, _far, _core; near: _id, _other, _d.

    In each round every component takes its least edge to another. Neighbour lists and the pivots bound that edge from above. Only points whose
    core distance is within the bound look for a shorter one, and only in cells that hold another component and may be near enough.
    Edges are compared by (weight, ids), a total order, so chosen edges never close a circle; rounds are the logarithm of the rows.
    """
    wide = near.join(cores.select("_id", F.col("_core").alias("_c1")), "_id").join(cores.select(F.col("_id").alias("_other"), F.col("_core").alias("_c2")), "_other")
    lists = saved(wide.select("_id", "_other", F.greatest("_d", "_c1", "_c2").alias("_w")), "lists")
    state = cores.withColumn("_comp", F.col("_id"))
    rows, tree, edges = cores.count(), None, 0
    heads, ids = pivots.x, pivots.ids
    by_id = np.argsort(ids)
    while edges < rows - 1:
        cells = pivots.measured(state, F.min("_comp").alias("least"), F.max("_comp").alias("most"), F.min("_core").alias("core"))
        order = np.array(sorted(cells))
        radius, least, most, core = (np.array([cells[c][k] for c in order.tolist()]) for k in ("radius", "least", "most", "core"))
        own = {r["_id"]: r for r in state.filter(F.col("_id").isin(ids.tolist())).select("_id", "_core", "_comp").collect()}  # one row a pivot
        head_core, head_comp = (np.array([own[i][k] for i in ids.tolist()]) for k in ("_core", "_comp"))

        def to_pivots(batches, heads=heads, ids=ids, head_core=head_core, head_comp=head_comp):
            for batch in batches:
                i, c, core = (batch.column(n).to_numpy() for n in ("_id", "_comp", "_core"))
                w = np.maximum(np.maximum(gaps(matrix(batch.column("_x")), heads), core[:, None]), head_core[None])
                w[c[:, None] == head_comp[None]] = np.inf
                if not w.size:
                    continue
                # the least edge of each row and of each pivot: of equal weights the smallest other end
                rows, pivot = np.arange(len(i)), np.arange(len(ids))
                ends = ((rows, by_id[w[:, by_id].argmin(1)]), ((by_row := np.argsort(i))[w[by_row].argmin(0)], pivot))
                ends = [(p[np.isfinite(w[p, q])], q[np.isfinite(w[p, q])]) for p, q in ends]
                sides = [_least(own, w[p, q], i[p], ids[q], c[p], head_comp[q]) for (p, q), own in zip(ends, (c[ends[0][0]], head_comp[ends[1][1]]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[n] for s in sides])) for n in sides[0]], list(sides[0]))

        comp = state.select("_id", F.col("_comp").alias("_cp"))
        listed = lists.join(comp, "_id").join(comp.select(F.col("_id").alias("_other"), F.col("_cp").alias("_cq")), "_other").filter("_cp <> _cq")
        swap = F.col("_id") > F.col("_other")
        ends = {"_lo": F.least("_id", "_other"), "_hi": F.greatest("_id", "_other"), "_c_lo": F.when(swap, F.col("_cq")).otherwise(F.col("_cp")), "_c_hi": F.when(swap, F.col("_cp")).otherwise(F.col("_cq"))}
        listed = listed.select(F.explode(F.array("_cp", "_cq")).alias("_own"), "_w", *[e.alias(n) for n, e in ends.items()])
        bound = saved(_least_rows(state.select("_id", "_x", "_core", "_comp").mapInArrow(to_pivots, _EDGE).unionByName(listed)), "bounds")

        def visits(batches, order=order, radius=radius, least=least, most=most, core=core):
            for batch in batches:
                if not len(batch):
                    continue
                c, limit = batch.column("_comp").to_numpy(), batch.column("_limit").to_numpy()
                d = gaps(matrix(batch.column("_x")), heads[order])
                other = (least[None] != c[:, None]) | (most[None] != c[:, None])
                i, j = np.nonzero(other & (d - radius <= limit[:, None] * (1 + 1e-9)) & (core[None] <= limit[:, None]))
                yield pa.RecordBatch.from_arrays([*(batch.column(n).take(pa.array(i)) for n in ("_id", "_x", "_core", "_comp", "_limit")), pa.array(order[j])], ["_id", "_x", "_core", "_comp", "_limit", "_cell"])

        # a component without a bound reaches all cells
        limited = state.join(bound.select(F.col("_own").alias("_comp"), F.col("_w").alias("_limit")), "_comp", "left").withColumn("_limit", F.coalesce("_limit", F.lit(float("inf"))))
        left = saved(limited.filter(F.col("_core") <= F.col("_limit")).select("_id", "_x", "_core", "_comp", "_limit").mapInArrow(visits, "_id long, _x array<double>, _core double, _comp long, _limit double, _cell long"), "visits")
        right = state.select("_id", "_x", "_core", "_comp", F.lit(0.0).alias("_limit"), "_cell")

        def nearest(left: pa.Table, right: pa.Table):
            (p, cp, kp, limit), (q, cq, kq) = ([t.column(n).to_numpy() for n in names] for t, names in ((left, ("_id", "_comp", "_core", "_limit")), (right, ("_id", "_comp", "_core"))))
            by = np.argsort(q)
            x, y, q, cq, kq = matrix(left.column("_x")), matrix(right.column("_x"))[by], q[by], cq[by], kq[by]
            low, at = np.full(len(p), np.inf), np.zeros(len(p), int)
            for begin in range(0, len(p) if len(q) else 0, TILE):
                rows = slice(begin, begin + TILE)
                w = np.maximum(np.maximum(gaps(x[rows], y), kp[rows, None]), kq[None])
                w[(cp[rows, None] == cq[None]) | (w > limit[rows, None])] = np.inf
                at[rows] = w.argmin(1)  # of equal weights the smallest id
                low[rows] = w.min(1)
            i = np.flatnonzero(np.isfinite(low))
            return _least(cp[i], low[i], p[i], q[at[i]], cp[i], cq[at[i]])

        searched = in_units(grid(left, right, "_cell", "_id", piece), "_cell", nearest, _EDGE)
        chosen = saved(_least_rows(bound.unionByName(searched)).drop("_own").distinct(), "chosen")
        fresh = chosen.count()
        if not fresh:
            raise RuntimeError("points without a distance to any other")
        edges += fresh
        tree = chosen.select("_w", "_lo", "_hi") if tree is None else tree.unionByName(chosen.select("_w", "_lo", "_hi"))
        if edges < rows - 1:
            joined = components(chosen, "_c_lo", "_c_hi").select(F.col("node").alias("_comp"), "component")
            state = saved(state.join(joined, "_comp", "left").select("_id", "_x", "_cell", "_far", "_core", F.coalesce("component", "_comp").alias("_comp")), "state")
    if tree is None:
        tree = cores.select(F.col("_core").alias("_w"), F.col("_id").alias("_lo"), F.col("_id").alias("_hi")).limit(0)
    return saved(tree, "tree")


def merged(edges: list[tuple], states: dict[int, tuple], least: int) -> tuple[dict, list, dict]:
    """Merge components along edges (w, edge, a, b) of rising weight; what edges of one weight connect merges at once, so ties have no order.

    states: of each component its rows, open cluster (None while it has fewer than `least` rows), the sum of densities at which rows left that
    cluster, their number, and the stability of the best choice of clusters below (None without any).
    Gives the component that each one ends in with that one's state, the clusters that were closed (cluster, parent, chosen), and the cluster that each component fell into.
    """
    top, inside, fell, closed = {r: r for r in states}, {r: [r] for r in states}, {}, []
    now = dict(states)

    def find(r: int) -> int:
        while top[r] != r:
            top[r] = top[top[r]]
            r = top[r]
        return r

    def join(parts: list[int], edge: int, density: float) -> None:
        new, open_ = min(parts), [r for r in parts if now[r][1] is not None]
        small = [r for r in parts if now[r][1] is None]
        n = sum(now[r][0] for r in parts)
        if len(open_) > 1:
            best = 0.0
            for r in open_:
                _, cluster, total, rows, below = now[r]
                stability = total - rows * density
                chosen = below is None or below <= stability
                closed.append((cluster, edge, chosen))
                best += stability if chosen else below
            state = (n, edge, n * density, n, best)
        elif open_:
            rows, cluster, total, left, below = now[open_[0]]
            state = (n, cluster, total + (n - rows) * density, left + n - rows, below)
        elif n >= least:
            state = (n, edge, n * density, n, None)
        else:
            state = (n, None, 0.0, 0, None)
        if state[1] is not None:  # rows of small components fall into the cluster
            for r in small:
                fell.update((x, state[1]) for x in inside[r])
                inside[r] = []
        kept = [x for r in parts for x in inside[r]]
        for r in parts:
            del now[r]
            top[r] = new
        now[new], inside[new] = state, kept

    edges = sorted(edges)
    begin = 0
    while begin < len(edges):
        end = begin + 1
        while end < len(edges) and edges[end][0] == edges[begin][0]:
            end += 1
        ties = [(edge, find(a), find(b)) for _, edge, a, b in edges[begin:end]]
        w = edges[begin][0]
        density = 1 / w if w > 0 else 1e12
        if len(ties) == 1:
            join([ties[0][1], ties[0][2]], ties[0][0], density)
        else:
            _, ends = np.unique([r for t in ties for r in t[1:]], return_inverse=True)
            node, root = forest(ends[::2], ends[1::2])
            of = dict(zip(node.tolist(), root.tolist(), strict=True))
            groups: dict[int, tuple[set, list]] = {}
            for (edge, a, b), x in zip(ties, ends[::2].tolist(), strict=True):
                roots, names = groups.setdefault(of.get(x, x), (set(), []))
                roots.update((a, b))
                names.append(edge)
            for roots, names in groups.values():
                join(sorted(roots), min(names), density)
        begin = end
    return {r: (find(r), now[find(r)]) for r in states}, closed, fell


_STATE = "_rep long, _new long, _rows long, _open long, _sum double, _left long, _below double, _fell long, _cluster long, _parent long, _chosen boolean"


def condensed(tree: DataFrame, points: DataFrame, least: int, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """(_id, _cluster) the cluster that each point falls out of, and (_cluster, _parent, _chosen) of the condensed tree. The last cluster has no row.

    Edges are merged in bands of rising weight of about `band` edges. In a band the components that its edges connect are merged in a task each; what was
    merged before stands in a table of components. So no task holds more than a band.
    """
    edges = saved(tree.withColumn("_edge", F.monotonically_increasing_id()), "edges")
    n = edges.count()
    bands = max(1, -(-n // band))
    cuts = sorted(set(edges.approxQuantile("_w", [i / bands for i in range(1, bands)], 0.1 / bands))) if bands > 1 else []
    where = points.select("_id", F.col("_id").alias("_rep"), F.lit(None).cast("long").alias("_cluster"))
    state = points.select(F.col("_id").alias("_rep"), F.lit(1).cast("long").alias("_rows"), F.lit(None).cast("long").alias("_open"), F.lit(0.0).alias("_sum"), F.lit(0).cast("long").alias("_left"), F.lit(None).cast("double").alias("_below"))
    if least <= 1:
        raise ValueError("clusters have two rows at least")
    clusters = None

    def run(table: pa.Table) -> pa.Table:
        edge = table.column("_w").is_valid()
        ends, parts = table.filter(edge), table.filter(pc.invert(edge))
        columns = [parts.column(n).to_pylist() for n in ("_rep", "_rows", "_open", "_sum", "_left", "_below")]
        states = {r: s for r, *s in zip(*columns, strict=True)}
        after, closed, fell = merged(list(zip(*(ends.column(n).to_pylist() for n in ("_w", "_edge", "_a", "_b")), strict=True)), states, least)
        names, kinds = [x.split()[0] for x in _STATE.split(", ")], {"double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64()}
        moved = {"_rep": list(after), "_new": [new for new, _ in after.values()], "_fell": [fell.get(r) for r in after]}
        moved |= {n: [s[k] for _, s in after.values()] for k, n in enumerate(("_rows", "_open", "_sum", "_left", "_below"))}
        ended = {n: [c[k] for c in closed] for k, n in enumerate(("_cluster", "_parent", "_chosen"))}
        sizes = len(after), len(closed)
        found = [moved.get(n, [None] * sizes[0]) + ended.get(n, [None] * sizes[1]) for n in names]
        return pa.table([pa.array(v, kinds[x.split()[1]]) for v, x in zip(found, _STATE.split(", "), strict=True)], names)

    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        own = edges if low is None else edges.filter(F.col("_w") > low)
        own = own if high is None else own.filter(F.col("_w") <= high)
        ends = where.select("_id", "_rep")
        own = own.join(ends.select(F.col("_id").alias("_lo"), F.col("_rep").alias("_a")), "_lo").join(ends.select(F.col("_id").alias("_hi"), F.col("_rep").alias("_b")), "_hi").select("_w", "_edge", "_a", "_b")
        if bands > 1:
            own = saved(own, "band")
            groups = components(own, "_a", "_b").select(F.col("node").alias("_rep"), F.col("component").alias("_group"))
            own = own.join(groups.select(F.col("_rep").alias("_a"), "_group"), "_a")
            taking = state.join(groups, "_rep")
        else:
            own, taking = own.withColumn("_group", F.lit(0).cast("long")), state.withColumn("_group", F.lit(0).cast("long"))
        found = saved(own.unionByName(taking, allowMissingColumns=True).groupBy("_group").applyInArrow(run, _STATE), "merged")
        moved = found.filter("_rep is not null").select("_rep", "_new", "_fell")
        where = where.join(moved, "_rep", "left").select("_id", F.coalesce("_new", "_rep").alias("_rep"), F.coalesce("_cluster", "_fell").alias("_cluster"))
        fresh = found.filter("_rep = _new").select(*state.columns)
        if bands > 1:
            where = saved(where, "where")
            fresh = saved(state.join(moved.select("_rep"), "_rep", "left_anti").unionByName(fresh), "components")
        state = fresh
        parts = found.filter("_cluster is not null").select("_cluster", "_parent", "_chosen")
        clusters = parts if clusters is None else clusters.unionByName(parts)
    return where.select("_id", "_cluster"), saved(clusters, "clusters")


def topmost(clusters: DataFrame) -> DataFrame:
    """(_cluster, _top): for each cluster the chosen one nearest to the root on its way there, if any. Paths are doubled."""
    up = clusters.select("_cluster", F.when(F.col("_chosen"), F.col("_cluster")).alias("_top"), F.col("_parent").alias("_up"))
    while True:
        above = up.select(F.col("_cluster").alias("_up"), F.col("_top").alias("_t"), F.col("_up").alias("_u"))
        up = saved(up.join(above, "_up", "left").select("_cluster", F.coalesce("_t", "_top").alias("_top"), F.col("_u").alias("_up")), "paths")
        if up.filter("_up is not null").isEmpty():
            return up.select("_cluster", "_top")


def hdbscan_table(features: DataFrame, id_col: str, vec: str = "features", min_cluster_size: int = 20, min_samples: int | None = None, noise: DataFrame | None = None, first: int = 0, piece: int = PIECE, pivots: int = PIVOTS, band: int = BAND) -> DataFrame:
    """(id, cluster_label), the labels of clustering.hdbscan for any number of rows; -1 is noise. noise: further rows (vec), clustered with the
    others and then left out (K08). A row that joins two clusters at the weight at which these meet is in neither; the kernel puts it by the order of its tree.

    Labels are numbered by the smallest id of a cluster. Rows without a vector, or with a null or NaN in it, are noise; rows that repeat an id are one point, at the
    smallest of their vectors. Fewer rows than min_cluster_size are all noise; an empty table gives an empty result.
    """
    rows = points_of(features, id_col, vec).groupBy("_id").agg(F.min("_x").alias("_x"))
    if noise is not None:
        # ids below all others, by the order of vectors, so that reruns agree
        rows = saved(rows, "real")
        low = rows.agg(F.min("_id")).first()[0] or 0
        extra = points_of(noise.select(F.monotonically_increasing_id().alias(id_col), F.col(vec)), id_col, vec)
        rows = rows.withColumn("_real", F.lit(True)).unionByName(extra.select((F.lit(low - 1) - F.col("_id")).alias("_id"), "_x").withColumn("_real", F.lit(False)))
    else:
        rows = rows.withColumn("_real", F.lit(True))
    rows = saved(rows, "points")
    n = rows.count()
    if n < max(2, min_cluster_size):
        return features.select(id_col, F.lit(-1).cast("long").alias("cluster_label"))
    heads = Pivots(rows, pivots)
    cores, near = k_nearest(rows.select("_id", "_x"), max(1, (min_samples or min_cluster_size) - 1), heads, piece)
    where, clusters = condensed(spanning_tree(cores, near, heads, piece), rows.select("_id"), min_cluster_size, band)
    tops = topmost(clusters) if not clusters.isEmpty() else clusters.select("_cluster", F.col("_cluster").alias("_top"))
    found = where.join(tops, "_cluster").select("_id", "_top").filter("_top is not null").join(rows.filter("_real").select("_id"), "_id")
    found = saved(found, "found")
    names = found.groupBy("_top").agg(F.min("_id").alias("_cluster"))
    return labelled(features, id_col, saved(found.join(names, "_top").select("_id", "_cluster"), "named"), first)
