"""Robust location and scale per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Makes the median absolute deviation of a normal sample its standard deviation.
MAD_SCALE = 1.4826


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median and mad (A01). Exact; for estimates over very large groups see approx_median_mad."""
    med = df.groupBy(*keys).agg(F.median(value).alias("median"))
    near = df.join(med, keys) if keys else df.crossJoin(F.broadcast(med))
    mad = near.groupBy(*keys).agg((F.median(F.abs(F.col(value) - F.col("median"))) * MAD_SCALE).alias("mad"), F.first("median").alias("median"))
    return mad.select(*keys, "median", "mad")


def approx_median_mad(df: DataFrame, keys: list[str], value: str, accuracy: int = 10_000) -> DataFrame:
    """The same from mergeable quantile sketches: state per key is bounded, whatever the group's size."""
    med = df.groupBy(*keys).agg(F.percentile_approx(value, 0.5, accuracy).alias("median"))
    near = df.join(med, keys)
    return near.groupBy(*keys).agg(F.first("median").alias("median"), (F.percentile_approx(F.abs(F.col(value) - F.col("median")), 0.5, accuracy) * MAD_SCALE).alias("mad"))


def robust_z(df: DataFrame, keys: list[str], value: str, stats: DataFrame, out: str = "z") -> DataFrame:
    """(x - median) / mad per key (W09); null where mad is zero."""
    scaled = F.try_divide(F.col(value) - F.col("median"), F.col("mad"))
    return df.join(stats, keys).withColumn(out, scaled).drop("median", "mad")


def common_reference(df: DataFrame, value: str, frame: list[str], out: str) -> DataFrame:
    """Long form of common reference removal: value less the median of its frame (W07). The median is an aggregate that is joined back, so frames need no window sort."""
    return df.join(df.groupBy(*frame).agg(F.median(value).alias("_ref")), frame).withColumn(out, F.col(value) - F.col("_ref")).drop("_ref")


def noise_from_head(df: DataFrame, channel: str, value: str, sample: str, sample_rate: float, duration: float, chunk: int, where: Column | None = None) -> DataFrame:
    """Median and MAD per channel over the first whole chunks of `duration` seconds."""
    length = int(duration * sample_rate) // chunk * chunk
    head = df.filter(F.col(sample) < length)
    return median_mad(head if where is None else head.filter(where), [channel], value)


def durations_per_segment(segments: DataFrame, segment: str, length: str, total: float) -> DataFrame:
    """How much of a total falls to each segment, taken in order (C07). One row per segment."""
    before = F.coalesce(F.sum(length).over(Window.orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.withColumn("duration", F.greatest(F.lit(0), F.least(F.col(length), F.lit(total) - before)))
