"""OPTICS of whole tables (K09): exact neighbours on pivots and a spanning tree, whose edges give the order of reachability that all pairs give."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .density import labelled, points_of
from .graph import saved
from .linkage import spanning_tree
from .neighbours import PIECE, PIVOTS, Pivots, k_nearest


def walked(core: np.ndarray, source: np.ndarray, to: np.ndarray, w: np.ndarray, eps: float | None) -> np.ndarray:
    """For each point, in the order of reachability over the edges source - to, the smallest point of its cluster at the cut; -1 is noise."""
    n = len(core)
    by = np.argsort(source, kind="stable")
    to, w = to[by], w[by]
    starts = np.searchsorted(source[by], np.arange(n + 1))
    reach, done, order = np.full(n, np.inf), np.zeros(n, bool), np.zeros(n, np.int64)
    open_: list[tuple[float, int]] = []
    begin = at = 0
    while at < n:
        while open_ and done[open_[0][1]]:
            heapq.heappop(open_)
        if open_:
            i = heapq.heappop(open_)[1]
        else:
            while done[begin]:
                begin += 1
            i = begin
        done[i] = True
        order[at] = i
        at += 1
        near = slice(starts[i], starts[i + 1])
        for j, v in zip(to[near].tolist(), w[near].tolist(), strict=True):
            if not done[j] and v < reach[j]:
                reach[j] = v
                heapq.heappush(open_, (v, j))
    finite = reach[np.isfinite(reach)]
    cut = eps if eps is not None else (1.5 * np.quantile(finite, 0.9) if len(finite) else 0.0)
    far, dense = reach[order] > cut, core[order] <= cut
    key = np.maximum(np.cumsum(far & dense) - 1, 0)
    key[far & ~dense] = -1
    least = np.full(n + 1, n)
    np.minimum.at(least, key, order)
    out = np.zeros(n, np.int64)
    out[order] = np.where(key < 0, -1, least[key])
    return out


def optics_table(features: DataFrame, id_col: str, vec: str = "features", min_samples: int = 5, max_eps: float = float("inf"), eps: float | None = None, first: int = 0, piece: int = PIECE, pivots: int = PIVOTS) -> DataFrame:
    """(id, cluster_label), the labels of clustering.optics for any number of rows; -1 is noise. Of equal reachabilities any may come first.

    A point is reached over max(core of the other, distance). Where that is less than its own core, the other is among its k nearest; where not, it is
    the mutual reachability, whose least edge out of any set of points is in the spanning tree. So these edges, a few a point, give the order.
    The order is one sequence: its walk takes one task, which holds ids, cores and these edges, no vectors and no pairs.
    """
    rows = saved(points_of(features, id_col, vec).groupBy("_id").agg(F.min("_x").alias("_x")), "points")
    if rows.isEmpty():
        return labelled(features, id_col, rows.select("_id", F.lit(None).cast("long").alias("_cluster")), first)
    heads = Pivots(rows, pivots)
    cores, near = k_nearest(rows, min_samples - 1, heads, piece)
    tree = spanning_tree(cores, near, heads, piece)
    listed = near.join(cores.select(F.col("_id").alias("_other"), "_core"), "_other").select(F.col("_other").alias("_a"), F.col("_id").alias("_b"), F.greatest("_d", "_core").alias("_w"))
    both = tree.select(F.explode(F.array(F.struct(F.col("_lo").alias("_a"), F.col("_hi").alias("_b")), F.struct(F.col("_hi").alias("_a"), F.col("_lo").alias("_b")))).alias("_e"), "_w")
    edges = listed.unionByName(both.select("_e._a", "_e._b", "_w")).filter(F.col("_w") <= max_eps)

    def run(table: pa.Table) -> pa.Table:
        a, w = table.column("_a").to_numpy(), table.column("_w").to_numpy()
        own = table.column("_b").is_null().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
        by = np.argsort(a[own])
        ids, core = a[own][by], w[own][by]
        b = table.column("_b").filter(pa.array(~own)).to_numpy()
        found = walked(np.where(core > max_eps, np.inf, core), np.searchsorted(ids, a[~own]), np.searchsorted(ids, b), w[~own], eps)
        return pa.table({"_id": ids, "_cluster": pa.array(np.where(found < 0, 0, ids[found]), mask=found < 0)})

    nodes = cores.select(F.col("_id").alias("_a"), F.lit(None).cast("long").alias("_b"), F.col("_core").alias("_w"))
    clusters = nodes.unionByName(edges).withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(run, "_id long, _cluster long")
    return labelled(features, id_col, saved(clusters, "clusters"), first)
