"""The whole way from a recording to a catalogue and to labelled events, as one ordered pipeline."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import robust, scalar
from ..operators import catalogue as cat
from ..operators import clustering, curation, detect, features, filters, peeling, relational, trains, waveforms
from ..operators.graph import saved
from ..sources.raw import to_long


@dataclass
class Parameters:
    """Defaults follow the number of channels where a field is None."""

    sample_rate: float
    highpass: float = 300.0
    lowpass: float | None = None
    sign: str = "-"
    threshold: float = 5.0
    span_ms: float = 0.7
    radius_um: float = 200.0
    left_ms: float = -1.0
    right_ms: float = 1.5
    alien: float | None = None
    n_sample: int = 20_000
    n_noise: int = 300
    method: str | None = None
    cluster: str = "hdbscan"
    cluster_options: dict = field(default_factory=dict)
    min_cluster_size: int = 20
    block: int | None = None
    split: bool = True
    merge: bool = True
    maximum_shift: int = 2

    def window(self, factor: float = 1.0) -> tuple[int, int]:
        left, right = (int(ms * factor / 1000 * self.sample_rate) for ms in (self.left_ms, self.right_ms))
        if left >= 0 or right <= 0:
            raise ValueError("a window starts before its peak and ends behind it")
        return left, right


def automatic(channels: int, sample_rate: float, **given) -> Parameters:
    """Parameters for a number of channels: few channels take one decomposition of all, many take one for each."""
    p = Parameters(sample_rate, **given)
    p.method = p.method or ("global_pca" if channels <= 4 else "pca_by_channel")
    return p


def process(frames: DataFrame, p: Parameters, noise_seconds: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Filtered, normalised frames and the (channel, median, mad) table they were normalised with."""
    block = p.block or max(1024, int(p.sample_rate))
    pad = scalar.halo_width(p.sample_rate, p.highpass)
    # the blocks that the noise is taken from, with their halo, are all that is filtered for it
    head = F.col("sample") < math.ceil(noise_seconds * p.sample_rate / block) * block + pad
    raw = filters.preprocess_blocks(frames.filter((F.col("segment") == 0) & head), filters.Preprocessing(p.sample_rate, p.highpass, p.lowpass), block, pad)
    noise = robust.median_mad(to_long(raw.filter((F.col("segment") == 0) & (F.col("sample") < noise_seconds * p.sample_rate))), ["channel"], "value")
    rows = {r["channel"]: r for r in noise.collect()}  # one row per channel
    order = sorted(rows)
    done = filters.Preprocessing(p.sample_rate, p.highpass, p.lowpass, medians=[rows[c]["median"] for c in order], mads=[rows[c]["mad"] for c in order])
    return filters.preprocess_blocks(frames, done, block, pad), noise


def build_catalogue(processed: DataFrame, probe: DataFrame, p: Parameters) -> tuple[cat.Catalogue, DataFrame]:
    """A catalogue and the labelled peaks it was made of: detection, sampling, features, clusters, split, not-aligned, merge, small and low ones out, order.

    processed should be materialised: it is read several times.
    """
    curation.ensure_checkpoint_dir(processed.sparkSession)
    signal = to_long(processed)
    near = detect.neighbourhood(probe, p.radius_um)
    n_span = scalar.half_window(p.sample_rate, p.span_ms)
    channels = probe.count()
    n_left, n_right = p.window()
    long_left, long_right = p.window(2.0)
    peaks = detect.detect_geometrical(signal, near, p.threshold, n_span, p.sign, p.block or max(1024, int(p.sample_rate))).withColumnRenamed("sample", "index")
    peaks = detect.number_peaks(peaks.withColumnRenamed("index", "sample")).withColumnRenamed("sample", "index").withColumn("cluster_label", F.lit(-11).cast("long"))
    peaks = trains.mark_aliens(peaks, "extremum_amplitude", "cluster_label", p.alien, p.sign)
    lengths = processed.groupBy("segment").agg((F.max("sample") + 1).alias("length"))
    inside = trains.inside_borders(peaks.filter("cluster_label <> -9"), "index", "segment", long_right - long_left, lengths)
    sampled = relational.sample_total(inside, "peak_id", p.n_sample).checkpoint()
    windows = waveforms.cut_windows(sampled, signal, n_left, n_right)
    waves = waveforms.as_arrays(windows).join(sampled.select("peak_id", F.col("channel").alias("peak_channel")), "peak_id").checkpoint()
    space = None
    if (p.method or ("global_pca" if channels <= 4 else "pca_by_channel")) == "global_pca":
        vectors, space = features.global_svd(waves, "peak_id", "wf", min(5, 2 * channels + 1))
    else:
        parts = features.svd_by_channel(waves, "peak_id", "wf", channels, "peak_channel", detect.neighbourhood(probe, p.radius_um, inclusive=False))
        grid = waves.select("peak_id").crossJoin(F.broadcast(parts.select("channel", "component").distinct()))
        dense = grid.join(parts, ["peak_id", "channel", "component"], "left").fillna(0.0, ["value"])
        cells = F.array_sort(F.collect_list(F.struct("channel", "component", "value")))
        vectors = dense.groupBy("peak_id").agg(F.transform(cells, lambda c: c["value"]).alias("features"))
    options = {"min_cluster_size": p.min_cluster_size} if p.cluster == "hdbscan" else {}
    if p.cluster == "dbscan_with_noise":
        if space is None:
            raise ValueError("noise rows need the features of one decomposition of all channels")
        noise = noise_windows(signal, inside, lengths, n_left, n_right, p.n_noise)
        options["noise"] = features.transform(noise, "peak_id", "wf", space).select("features")
    vectors = vectors.checkpoint()
    labels = clustering.find_clusters(vectors, "peak_id", p.cluster, **options | p.cluster_options).checkpoint()
    if p.split:
        valid = vectors.join(labels.filter("cluster_label >= 0"), "peak_id")
        pieces = clustering.split_labels(clustering.auto_split(valid, "peak_id", min_cluster_size=p.min_cluster_size).checkpoint())
        labels = pieces.select("peak_id", "cluster_label").unionByName(labels.filter("cluster_label < 0").select("peak_id", "cluster_label"))
    labelled = sampled.drop("cluster_label").join(labels, "peak_id")
    labelled = curation.trash_small(labelled, p.min_cluster_size // 2).checkpoint()
    labelled = clean_clusters(labelled, waves.drop("peak_channel"), channels, n_left, p).checkpoint()
    picked = waveforms.cached_waveforms(labelled, "cluster_label")
    long_windows = waveforms.cut_windows(picked, signal, long_left, long_right, lengths).join(picked.select("peak_id", "cluster_label"), "peak_id")
    centres = waveforms.centroids(long_windows, "cluster_label").checkpoint()
    summary = waveforms.centroid_summary(centres, "cluster_label", -long_left, p.sign)
    low = curation.trash_low(labelled, summary.select("cluster_label", "extremum_amplitude"), p.threshold + 0.5).checkpoint()
    kept = low.filter("cluster_label >= 0").select("cluster_label").distinct()
    ordered = curation.order_clusters(summary.join(kept, "cluster_label", "left_semi").withColumn("cell_label", F.col("cluster_label")))
    renumber = ordered.select(F.col("cluster_label").alias("old"), F.col("new_label").alias("new"))
    labelled = curation.relabel(low, renumber)
    centres = centres.join(renumber.withColumnRenamed("old", "cluster_label"), "cluster_label").drop("cluster_label").withColumnRenamed("new", "cluster_label")
    pairs = near.select("c1", "c2").collect()  # a probe's channel pairs
    neighbours = [sorted(b for a, b in pairs if a == c) for c in range(channels)]
    made = cat.from_centroids(centres, "cluster_label", channels, n_left=n_left, n_right=n_right, n_left_long=long_left, sample_rate=p.sample_rate, threshold=p.threshold, n_span=n_span, sign=p.sign, alien=p.alien, neighbours=neighbours)
    return made, labelled


def noise_windows(signal: DataFrame, peaks: DataFrame, lengths: DataFrame, n_left: int, n_right: int, number: int) -> DataFrame:
    """peak_id and wf of noise snippets, number // segments of each segment."""
    each = max(1, number // max(1, lengths.count()))
    at = waveforms.noise_positions(lengths, peaks, n_left, n_right, each)
    at = at.withColumn("peak_id", F.xxhash64("segment", "index"))
    return waveforms.as_arrays(waveforms.cut_windows(at, signal, n_left, n_right))


def clean_clusters(labelled: DataFrame, waves: DataFrame, channels: int, n_left: int, p: Parameters) -> DataFrame:
    """Peaks with clusters trashed whose extremum is not at the peak (K16), and clusters merged that are one (K17). waves: peak_id, wf."""
    picked = waveforms.cached_waveforms(labelled, "cluster_label").select("peak_id", "cluster_label").join(waves, "peak_id")
    long = waveforms.long_form(picked, "peak_id", "wf", channels, "cluster_label")
    centres = waveforms.centroids(long, "cluster_label").checkpoint()
    place = (F.max_by if p.sign == "+" else F.min_by)("offset", "median").alias("offset")
    labelled = curation.trash_misaligned(labelled, centres.groupBy("cluster_label").agg(place), n_left, p.maximum_shift)
    if p.merge:
        kept = labelled.filter("cluster_label >= 0").select("cluster_label").distinct()
        centres_kept = centres.join(kept, "cluster_label", "left_semi")
        together = waveforms.shared_channels(waveforms.sparse_mask(centres_kept, "cluster_label", 1.5), "cluster_label")
        labelled = curation.relabel(labelled, clustering.auto_merge(picked, centres_kept, together))
    return labelled


def sort_recording(frames: DataFrame, probe: DataFrame, p: Parameters) -> tuple[cat.Catalogue, DataFrame]:
    """Catalogue and spikes of a recording."""
    processed = saved(process(frames, p)[0], "processed")
    made, _ = build_catalogue(processed, probe, p)
    return made, peeling.peel_blocks(processed, made, p.block or 10 * int(p.sample_rate))
