"""Peak detection as window expressions over signals in long form (segment, channel, sample, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .relational import with_halo


def _beyond(value: Column, sign: str, threshold: float) -> Column:
    if sign not in "+-":
        raise ValueError("sign is '+' or '-'")
    return value > threshold if sign == "+" else value < -threshold


def _extreme(sign: str):
    return F.max if sign == "+" else F.min


def _further(a: Column, b: Column, sign: str, strict: bool) -> Column:
    if sign == "+":
        return a > b if strict else a >= b
    return a < b if strict else a <= b


def local_extremum(value: Column, order: WindowSpec, n_span: int, sign: str) -> Column:
    """Further out than the n_span rows before (strictly) and after (ties allowed), with full windows on both sides."""
    before, after = order.rowsBetween(-n_span, -1), order.rowsBetween(1, n_span)
    full = (F.count(F.lit(1)).over(before) == n_span) & (F.count(F.lit(1)).over(after) == n_span)
    best = _extreme(sign)
    return full & _further(value, best(value).over(before), sign, True) & _further(value, best(value).over(after), sign, False)


def rectified_sum(signal: DataFrame, threshold: float, sign: str = "-", frame: tuple[str, ...] = ("segment", "sample"), value: str = "value") -> DataFrame:
    """Per frame, the sum over channels of the values at or beyond the threshold."""
    kept = F.when(_further(F.col(value), F.lit(threshold if sign == "+" else -threshold), sign, False), F.col(value)).otherwise(F.lit(0.0))
    return signal.groupBy(*frame).agg(F.sum(kept).alias("rectified"))


def spatial_kernel(distances: DataFrame, radius: float) -> DataFrame:
    """Weights exp(-distance / radius) of channel pairs (c1, c2, distance); below 0.01 they are zero."""
    w = F.exp(-F.col("distance") / F.lit(float(radius)))
    return distances.withColumn("weight", F.when(w < 0.01, 0.0).otherwise(w))


def smooth_over_channels(signal: DataFrame, kernel: DataFrame, value: str = "value") -> DataFrame:
    """Each channel becomes the weighted sum of all; kernel (c1, c2, weight) is a small probe table."""
    pairs = kernel.filter("weight > 0").select(F.col("c1").alias("channel"), F.col("c2").alias("_to"), "weight")
    out = signal.join(F.broadcast(pairs), "channel").groupBy("segment", "sample", F.col("_to").alias("channel"))
    return out.agg(F.sum(F.col(value) * F.col("weight")).alias(value))


def detect_global(signal: DataFrame, threshold: float, n_span: int, sign: str = "-", block: int | None = None) -> DataFrame:
    """Peaks of the rectified sum (E01): segment, sample, channel -1, amplitude 0. block parts long segments into halo blocks."""
    summed = rectified_sum(signal, threshold, sign)
    keys = ["segment"]
    if block:
        summed, keys = with_halo(summed, "sample", block, n_span), ["segment", "block"]
    order = Window.partitionBy(*keys).orderBy("sample")
    found = summed.withColumn("_peak", local_extremum(F.col("rectified"), order, n_span, sign)).filter("_peak")
    found = found.filter(F.col("rectified") != 0)
    return (found.filter("core") if block else found).select("segment", "sample", F.lit(-1).alias("channel"), F.lit(0.0).alias("extremum_amplitude"))


def detect_geometrical(signal: DataFrame, neighbours: DataFrame, threshold: float, n_span: int, sign: str = "-", block: int | None = None) -> DataFrame:
    """Peaks that stand out in time and among neighbour channels.

    neighbours: (c1, c2) with each channel its own neighbour, a probe-size table. Sliding extremes are taken once per channel, then
    only rows beyond the threshold are joined with those of their neighbours.
    """
    keys = ["segment", "channel"]
    if block:
        signal, keys = with_halo(signal, "sample", block, n_span), ["segment", "block", "channel"]
    order = Window.partitionBy(*keys).orderBy("sample")
    before, after = order.rowsBetween(-n_span, -1), order.rowsBetween(1, n_span)
    best = _extreme(sign)
    slid = signal.withColumn("_before", F.when(F.count(F.lit(1)).over(before) == n_span, best("value").over(before)))
    slid = slid.withColumn("_after", F.when(F.count(F.lit(1)).over(after) == n_span, best("value").over(after)))
    if block:
        slid = slid.filter("core")
    over = slid.filter(_beyond(F.col("value"), sign, threshold) & F.col("_before").isNotNull() & F.col("_after").isNotNull()).select("segment", "sample", "channel", "value")
    around = slid.select("segment", "sample", F.col("channel").alias("_c2"), F.col("value").alias("_v"), "_before", "_after")
    near = over.join(F.broadcast(neighbours.select(F.col("c1").alias("channel"), F.col("c2").alias("_c2"))), "channel").join(around, ["segment", "sample", "_c2"])
    ok = _further(F.col("value"), F.col("_v"), sign, False) & _further(F.col("value"), F.col("_before"), sign, True) & _further(F.col("value"), F.col("_after"), sign, False)
    found = near.groupBy("segment", "sample", "channel", "value").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("_peak")).filter("_peak")
    return found.select("segment", "sample", "channel", F.col("value").alias("extremum_amplitude"))


def detector(method: str, engine: str = "catalyst"):
    """The detector for a method; every known engine name runs the same plan."""
    if engine not in ("catalyst", "numpy", "numba", "opencl"):
        raise ValueError(f"unknown engine {engine}")
    return {"global": detect_global, "geometrical": detect_geometrical}[method]


def number_peaks(peaks: DataFrame, base: int = 0) -> DataFrame:
    """peak_id without a global sort: ids rise with (segment, sample, channel) within each segment, segments one after the other."""
    counts = peaks.groupBy("segment").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).drop("_n")
    rank = F.row_number().over(Window.partitionBy("segment").orderBy("sample", "channel"))
    return peaks.withColumn("_rank", rank).join(F.broadcast(starts), "segment").withColumn("peak_id", F.col("_rank") - 1 + F.col("_before") + base).drop("_rank", "_before")


def neighbourhood(probe: DataFrame, radius: float, inclusive: bool = True) -> DataFrame:
    """Channel pairs (c1, c2, distance) of a group within a radius: inclusive for detection (P04), exclusive for clustering."""
    d = channel_distances(probe)
    return d.filter(F.col("distance") <= radius if inclusive else F.col("distance") < radius)


def channel_distances(probe: DataFrame) -> DataFrame:
    """Euclidean distance of all channel pairs of a group."""
    a = probe.select("chan_grp", F.col("channel").alias("c1"), F.col("x").alias("_x1"), F.col("y").alias("_y1"))
    b = probe.select("chan_grp", F.col("channel").alias("c2"), F.col("x").alias("_x2"), F.col("y").alias("_y2"))
    gap = F.sqrt(F.pow(F.col("_x1") - F.col("_x2"), 2) + F.pow(F.col("_y1") - F.col("_y2"), 2))
    return a.join(b, "chan_grp").select("chan_grp", "c1", "c2", gap.alias("distance"))


def default_geometry(spark, chan_grp: int, channels: list[int]) -> DataFrame:
    """A tetrode cross for four channels, else a line at 100 um."""
    n = len(channels)
    at = [(round(50 * math.sin(math.pi / 2 * i)), round(50 * math.cos(math.pi / 2 * i))) for i in range(4)] if n == 4 else [(0, 100 * i) for i in range(n)]
    rows = [(chan_grp, i, c, float(x), float(y)) for i, (c, (x, y)) in enumerate(zip(channels, at, strict=True))]
    return spark.createDataFrame(rows, "chan_grp int, pos int, channel int, x double, y double")
