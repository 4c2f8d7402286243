"""Components of link tables, durable intermediates, numbering: what clustering on whole tables is made of."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .curation import ensure_checkpoint_dir


def saved(df: DataFrame, name: str = "rows") -> DataFrame:
    """Cut lineage: df as Parquet in the checkpoint folder, read again. A lost executor costs a re-read."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/clusters/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) for every node of the links a - b that is not its own smallest."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    x, y, up = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while len(x):
        u, v = up[x], up[y]
        open_ = u != v
        x, y, u, v = x[open_], y[open_], u[open_], v[open_]
        np.minimum.at(up, np.maximum(u, v), np.minimum(u, v))
        while (up[up] != up).any():
            up = up[up]
    moved = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[moved], nodes[up[moved]]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node that it reaches.

    Tasks contract their own links first. A round then hooks each node to its smallest neighbour, doubles paths until they end at roots and
    contracts the links: rounds and doublings are logarithmic, tables are written between them.
    """

    def contracted(batches):
        for batch in batches:
            ends = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["_hi", "_lo"])

    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    ordered = links.filter(x != y).select(F.greatest(x, y).alias("_hi"), F.least(x, y).alias("_lo"))
    left = saved(ordered.mapInArrow(contracted, "_hi long, _lo long").distinct(), "links")
    labels = None
    while not left.isEmpty():
        up, moving = saved(left.groupBy("_hi").agg(F.min("_lo").alias("_up")), "hooks"), True
        while moving:
            above = up.select(F.col("_hi").alias("_up"), F.col("_up").alias("_top"))
            step = saved(up.join(above, "_up", "left").select("_hi", F.coalesce("_top", "_up").alias("_up"), F.col("_top").isNotNull().alias("_moved")), "hooks")
            up, moving = step.select("_hi", "_up"), not step.filter("_moved").isEmpty()
        ends = {c: up.select(F.col("_hi").alias(c), F.col("_up").alias(f"{c}_top")) for c in ("_hi", "_lo")}
        far = left.join(ends["_hi"], "_hi", "left").join(ends["_lo"], "_lo", "left").select(F.coalesce("_hi_top", "_hi").alias("p"), F.coalesce("_lo_top", "_lo").alias("q"))
        left = saved(far.filter("p <> q").select(F.greatest("p", "q").alias("_hi"), F.least("p", "q").alias("_lo")).distinct(), "links")
        if labels is not None:
            moved = labels.join(up.select(F.col("_hi").alias("_up"), F.col("_up").alias("_top")), "_up", "left").select("_hi", F.coalesce("_top", "_up").alias("_up"))
            up = moved.unionByName(up)
        labels = saved(up, "labels")
    if labels is None:
        return left.select(F.col("_hi").alias("node"), F.col("_lo").alias("component"))
    roots = labels.select(F.col("_up").alias("_hi"), "_up").distinct()
    return labels.unionByName(roots).select(F.col("_hi").alias("node"), F.col("_up").alias("component"))


def numbered(values: DataFrame, col: str, out: str, bucket: int = 100_000) -> DataFrame:
    """values (one distinct column) with their place in rising order, from 0.

    Quantiles cut the values into ranges of about `bucket` rows; a range is numbered in one task and the driver sees one count of each.
    """
    n = values.count()
    cuts = sorted(set(values.approxQuantile(col, [i / (1 + n // bucket) for i in range(1, 1 + n // bucket)], 0.1 / (1 + n // bucket)))) if n > bucket else []
    placed = values.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(col))) if cuts else F.lit(0))
    counts = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()} if cuts else {}
    before = F.lit(0)
    if cuts:
        sums = np.r_[0, np.cumsum([counts.get(i, 0) for i in range(len(cuts) + 1)])].tolist()
        before = F.element_at(F.array(*map(F.lit, sums)), F.col("_range") + 1)
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(col)) - 1
    return placed.withColumn(out, (before + rank).cast("long")).drop("_range")
