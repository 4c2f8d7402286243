"""Waveforms: windows cut from signals, centroids, masks, reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.robust import MAD_SCALE
from .relational import range_join, sample_per_key


def cut_windows(peaks: DataFrame, signal: DataFrame, n_left: int, n_right: int, lengths: DataFrame | None = None, channels: DataFrame | None = None, block: int = 4096) -> DataFrame:
    """Long-form waveforms (peak_id, offset, channel, value) of samples index + n_left ... index + n_right - 1.

    A bucketed range join of peaks with the signal, per segment. Windows that leave the segment are dropped whole where lengths
    (segment, length) is given; every row carries its peak_id, so nothing shifts. channels (peak channel c1, kept channel c2)
    restricts each peak to the neighbours of its channel.
    """
    width = n_right - n_left
    if lengths is not None:
        start = F.col("index") + n_left
        peaks = peaks.join(F.broadcast(lengths), "segment").filter((start >= 0) & (start < F.col("length") - width)).drop("length")
    kept = ["peak_id", "segment", "index"]
    p = peaks.select(*kept, *([F.col("channel").alias("_c1")] if channels is not None else []))
    rows = range_join(p, signal, F.col("index") + n_left, F.col("index") + (n_right - 1), F.col("sample"), block, ["segment"])
    if channels is not None:
        near = channels.select(F.col("c1").alias("_c1"), F.col("c2").alias("channel"))
        rows = rows.join(F.broadcast(near), ["_c1", "channel"], "left_semi")
    return rows.select("peak_id", (F.col("sample") - F.col("index") - n_left).cast("int").alias("offset"), "channel", "value")


def as_arrays(windows: DataFrame) -> DataFrame:
    """peak_id and wf, one flat array in order of (offset, channel)."""
    cell = F.struct("offset", "channel", "value")
    return windows.groupBy("peak_id").agg(F.array_sort(F.collect_list(cell)).alias("_cells")).select("peak_id", F.transform("_cells", lambda c: c["value"]).alias("wf"))


def long_form(waves: DataFrame, id_col: str, wave: str, channels: int, *more: str) -> DataFrame:
    """Flat (width x channel) arrays as rows (id, offset, channel, value)."""
    out = waves.select(id_col, *more, F.posexplode(wave).alias("_i", "value"))
    return out.select(id_col, *more, F.floor(F.col("_i") / channels).cast("int").alias("offset"), (F.col("_i") % channels).alias("channel"), F.col("value").cast("double").alias("value"))


def centroids(windows: DataFrame, label: str) -> DataFrame:
    """Median, MAD, mean and standard deviation of each (label, offset, channel)."""
    keys = [label, "offset", "channel"]
    first = windows.groupBy(*keys).agg(F.median("value").alias("median"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    mad = windows.join(first.select(*keys, "median"), keys).groupBy(*keys).agg((F.median(F.abs(F.col("value") - F.col("median"))) * MAD_SCALE).alias("mad"))
    return first.join(mad, keys)


def centroid_summary(centres: DataFrame, label: str, at: int, sign: str = "-") -> DataFrame:
    """extremum_channel, extremum_amplitude (at offset `at`) and waveform_rms of each centroid."""
    here = F.when(F.col("offset") == at, F.struct((-F.col("median") if sign == "+" else F.col("median")).alias("v"), "channel"))
    out = centres.groupBy(label).agg(F.min(here).alias("_best"), F.sqrt(F.avg(F.col("median") * F.col("median"))).alias("waveform_rms"), F.min("median").alias("low"), F.max("median").alias("high"))
    return out.select(label, F.col("_best.channel").alias("extremum_channel"), (F.col("_best.v") * (-1 if sign == "+" else 1)).alias("extremum_amplitude"), "waveform_rms", "low", "high")


def value_at(waves: DataFrame, id_col: str, wave: str, channels: int, at: int) -> DataFrame:
    """peak_max features: the values of all channels at one offset."""
    return waves.select(id_col, F.slice(wave, at * channels + 1, channels).alias("features"))


def sparse_mask(centres: DataFrame, label: str, threshold: float | None = None, nbest: int | None = None, value: str = "median") -> DataFrame:
    """(label, channel, kept): channels where a centroid exceeds the threshold anywhere, or its nbest channels."""
    if (threshold is None) == (nbest is None):
        raise ValueError("give either threshold or nbest")
    top = centres.groupBy(label, "channel").agg(F.max(F.abs(F.col(value))).alias("_top"))
    if threshold is not None:
        return top.select(label, "channel", (F.col("_top") > threshold).alias("kept"))
    order = Window.partitionBy(label).orderBy(F.desc("_top"), F.desc("channel"))
    return top.select(label, "channel", (F.row_number().over(order) <= nbest).alias("kept"))


def shared_channels(mask: DataFrame, label: str) -> DataFrame:
    """Pairs of clusters and whether they share enough channels (P11): one where the smaller has four or fewer, else more than half of it."""
    on = mask.filter("kept")
    size = on.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    names = mask.select(label).distinct()
    sized = names.join(size, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))
    pairs = sized.select(F.col(label).alias("label_i"), F.col("n").alias("n_i")).crossJoin(sized.select(F.col(label).alias("label_j"), F.col("n").alias("n_j")))
    shared = on.select(F.col(label).alias("label_i"), "channel").join(on.select(F.col(label).alias("label_j"), "channel"), "channel").groupBy("label_i", "label_j").agg(F.count(F.lit(1)).alias("shared"))
    out = pairs.join(shared, ["label_i", "label_j"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    least = F.least("n_i", "n_j")
    return out.select("label_i", "label_j", "shared", F.when(least <= 4, F.col("shared") >= 1).otherwise(F.col("shared") * 2 > least).alias("together"))


def common_channels(mask: DataFrame, label: str, visible: DataFrame) -> DataFrame:
    """Channels that any visible cluster keeps."""
    return mask.join(F.broadcast(visible), label, "left_semi").groupBy("channel").agg(F.bool_or("kept").alias("kept"))


def noise_positions(lengths: DataFrame, peaks: DataFrame, n_left: int, n_right: int, per_segment: int, seed: int = 0, draw: int = 20) -> DataFrame:
    """Positions of noise snippets: pseudo-random samples of each segment that no peak window reaches and that lie a width from its ends.

    draw candidates are tried for each one wanted. Where peaks leave nothing free, any position inside the borders will do.
    """
    from .relational import id_order, uncovered

    width = n_right - n_left
    span = F.greatest(F.col("length") - 2 * width - 1, F.lit(1))
    tries = lengths.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(per_segment * draw)))).withColumn("_h", F.col("segment") * 1_000_003 + F.col("_k"))
    tries = tries.select("segment", (id_order("_h", seed) % span + width + 1).cast("long").alias("index")).distinct()
    free = uncovered(tries, peaks.select("segment", F.col("index").alias("_p")), "index", F.col("_p") - width, F.col("_p") + width, 4096, ["segment"])
    ranked = free.withColumn("_free", F.lit(0)).unionByName(tries.withColumn("_free", F.lit(1))).groupBy("segment", "index").agg(F.min("_free").alias("_free"))
    order = Window.partitionBy("segment").orderBy("_free", id_order("index", seed + 1), "index")
    return ranked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_segment).select("segment", "index", F.lit(-2).cast("long").alias("cluster_label"))


def cached_waveforms(peaks: DataFrame, label: str, per_cluster: int = 350, seed: int = 0) -> DataFrame:
    """The peaks whose waveforms stand for their cluster."""
    return sample_per_key(peaks.filter(F.col(label) >= 0), [label], "peak_id", per_cluster, seed)


def reconstruct(spikes: DataFrame, templates: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Sum of the templates of all spikes (X13): (segment, sample, channel, value). templates: label, offset (relative to the spike), channel, value."""
    placed = spikes.filter(F.col(label) >= 0).join(F.broadcast(templates), label)
    return placed.groupBy("segment", (F.col("index") + F.col("offset")).alias("sample"), "channel").agg(F.sum("value").alias("value"))


def residual(signal: DataFrame, prediction: DataFrame) -> DataFrame:
    """signal less prediction, zero where nothing was predicted."""
    keys = ["segment", "sample", "channel"]
    return signal.join(prediction.withColumnRenamed("value", "_p"), keys, "left").withColumn("value", F.col("value") - F.coalesce("_p", F.lit(0.0))).drop("_p")


def density(windows: DataFrame, keys: list[str], low: float, high: float, bins: int) -> DataFrame:
    """Counts per keys, channel, offset and amplitude bin; values outside fall to the edge bins."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("value") - low) / ((high - low) / bins)))).cast("long")
    return windows.groupBy(*keys, "channel", "offset", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def jitter(y0: Column, y1: Column, y2: Column) -> Column:
    """Sub-sample shift of an extremum from three samples around it, by a second-order expansion."""
    return F.try_divide(y0 - y2, 2 * (y0 - 2 * y1 + y2))
