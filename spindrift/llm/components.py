"""Connected components of a link table, without bringing links or labels to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

TASK_LINKS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) by the links a - b, for every node that is not its own smallest."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    x, y, up = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        u, v = up[x], up[y]
        apart = u != v
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(up, np.maximum(u[apart], v[apart]), np.minimum(u[apart], v[apart]))
        while (up[up] != up).any():
            up = up[up]
    moved = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[moved], nodes[up[moved]]


def _contracted(links: DataFrame, tasks: int) -> DataFrame:
    """links (_hi, _lo) as a forest of each task: what the links of a task connect is connected still, by fewer links."""

    def run(batches):
        ends = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        hi, lo = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*ends) if ends else ([], [])))
        for begin in range(0, len(hi), 4 * TASK_LINKS):
            found = forest(hi[begin : begin + 4 * TASK_LINKS], lo[begin : begin + 4 * TASK_LINKS])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["_hi", "_lo"])

    return links.coalesce(tasks).mapInArrow(run, "_hi long, _lo long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node that it reaches.

    Each task first contracts its own links to a forest; where one task has them all, that is the result. Otherwise each round hooks
    every node to its smallest neighbour, compresses the paths by pointer doubling and contracts
    the graph; rounds and doublings are logarithmic. Tables are written between steps, so lineage stays short. Null ends and
    loops are ignored.
    """
    lo, hi = F.least(a, b).cast("long"), F.greatest(a, b).cast("long")
    left = materialise(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(hi.alias("_hi"), lo.alias("_lo")).filter("_hi <> _lo"), "links")
    n = left.count()
    if not n:
        return left.select(F.col("_hi").alias("node"), F.col("_lo").alias("component"))
    tasks = 1 + n // TASK_LINKS
    left = materialise(_contracted(left, tasks), "links")
    labels = left.select("_hi", F.col("_lo").alias("_up")) if tasks == 1 else _rounds(left)
    roots = labels.select(F.col("_up").alias("_hi"), "_up").distinct()
    return labels.unionByName(roots).select(F.col("_hi").alias("node"), F.col("_up").alias("component"))


def _rounds(left: DataFrame) -> DataFrame:
    labels = None
    while not left.isEmpty():
        up = materialise(left.groupBy("_hi").agg(F.min("_lo").alias("_up")), "hooks")
        while True:
            above = up.select(F.col("_hi").alias("_up"), F.col("_up").alias("_top"))
            step = materialise(up.join(above, "_up", "left").select("_hi", F.coalesce("_top", "_up").alias("_up"), F.col("_top").isNotNull().alias("_moved")), "hooks")
            up = step.select("_hi", "_up")
            if step.filter("_moved").isEmpty():
                break
        if labels is None:
            labels = up
        else:
            moved = labels.join(up.select(F.col("_hi").alias("_up"), F.col("_up").alias("_top")), "_up", "left").select("_hi", F.coalesce("_top", "_up").alias("_up"))
            labels = materialise(moved.unionByName(up), "labels")
        left = left.join(up, "_hi", "left").select(F.coalesce("_up", "_hi").alias("_hi"), "_lo")
        left = left.join(up.select(F.col("_hi").alias("_lo"), F.col("_up").alias("_low")), "_lo", "left").select("_hi", F.coalesce("_low", "_lo").alias("_lo"))
        left = materialise(left.filter("_hi <> _lo").select(F.greatest("_hi", "_lo").alias("_hi"), F.least("_hi", "_lo").alias("_lo")).distinct(), "links")
    return labels
