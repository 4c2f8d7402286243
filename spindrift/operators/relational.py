"""General relational operators: range joins as equi-joins, halos, dense bins, deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, low: Column, high: Column, point: Column, width: int, keys: list[str]) -> DataFrame:
    """Pairs with low <= point <= high and equal keys, as a bucketed equi-join.

    low and high are integer expressions over left, point over right. Right rows are placed in buckets of `width`; left rows are
    repeated for the buckets that their range touches, two at most where ranges are no longer than width. Spark plans an ordinary
    shuffled or broadcast join on (keys, bucket) instead of a Cartesian product, and AQE splits skewed buckets.
    """
    spread = left.withColumn("_low", low).withColumn("_high", high).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))))
    placed = right.withColumn("_point", point).withColumn("_bucket", F.floor(F.col("_point") / width))
    joined = spread.join(placed, [*keys, "_bucket"])
    return joined.filter((F.col("_point") >= F.col("_low")) & (F.col("_point") <= F.col("_high"))).drop("_bucket", "_low", "_high", "_point")


def with_halo(df: DataFrame, sample: str, block: int, pad: int, pad_right: int | None = None) -> DataFrame:
    """Each row for every block that needs it: its own, and neighbours within pad samples; adds block and core (own block)."""
    right = pad if pad_right is None else pad_right
    own = F.floor(F.col(sample) / block)
    blocks = F.sequence(F.floor((F.col(sample) - right) / block), F.floor((F.col(sample) + pad) / block))
    return df.withColumn("block", F.explode(blocks)).filter("block >= 0").withColumn("core", F.col("block") == own)


def dense_bins(counts: DataFrame, keys: DataFrame, bin_col: str, first: int, last: int, count: str) -> DataFrame:
    """counts with a zero for every key and bin in [first, last] that has no row."""
    grid = keys.withColumn(bin_col, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
    return grid.join(counts, [*keys.columns, bin_col], "left").withColumn(count, F.coalesce(count, F.lit(0).cast("long")))


def id_order(id_col: str, seed: int = 0) -> Column:
    """A pseudo-random order that depends on the id alone, in arithmetic that every SQL engine shares."""
    return F.pmod((F.pmod(F.col(id_col), F.lit(2147483648)) + F.lit(seed)) * F.lit(2654435761), F.lit(4294967296))


def sample_per_key(df: DataFrame, keys: list[str], id_col: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each key, first in id_order (F01, F04, C09). Spark prunes to n rows in each task before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(id_order(id_col, seed), F.col(id_col))
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def sample_total(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, first in id_order: a distributed top-n, without a global sort."""
    return df.orderBy(id_order(id_col, seed), F.col(id_col)).limit(n)


def uncovered(points: DataFrame, intervals: DataFrame, point: str, low: Column, high: Column, width: int, keys: list[str]) -> DataFrame:
    """Points that no interval of the same keys covers (J08): the covered ones, by range join, are anti-joined."""
    covered = range_join(intervals, points.select(*keys, point), low, high, F.col(point), width, keys).select(*keys, point).distinct()
    return points.join(covered, [*keys, point], "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
