"""Operators over event trains: intervals, correlograms, collisions, counts, rates, exports of labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import dense_bins


def counts(events: DataFrame, *keys: str) -> DataFrame:
    """Events per key."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def intervals(events: DataFrame, index: str, keys: list[str], id_col: str) -> DataFrame:
    """Gap to the event before of the same keys."""
    order = Window.partitionBy(*keys).orderBy(index, id_col)
    return events.withColumn("gap", F.col(index) - F.lag(index).over(order)).filter("gap is not null")


def histogram(values: DataFrame, value: Column, low: float, high: float, width: float, keys: list[str]) -> DataFrame:
    """Counts per keys and bin of [low, high]; the last bin is closed."""
    bins = round((high - low) / width)
    bin_no = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("long")
    return values.filter((value >= low) & (value <= high)).groupBy(*keys, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def interval_histogram(events: DataFrame, index: str, label: str, segment: str, id_col: str, sample_rate: float, low: float, high: float, width: float) -> DataFrame:
    """Histogram of inter-event intervals in ms per label, within segments."""
    gaps = intervals(events, index, [segment, label], id_col)
    return histogram(gaps, F.col("gap") / sample_rate * 1000.0, low, high, width, [label])


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the labels of a column, a null being one of them, and these labels."""
    coded = pc.dictionary_encode(pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type), null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _counted(sums: np.ndarray, names: pa.Array) -> pa.Table:
    """Rows of the counts above zero of sums (label, label, bin)."""
    i, j, b = np.nonzero(sums)
    return pa.table({"label_i": names.take(pa.array(i)), "label_j": names.take(pa.array(j)), "bin": pa.array(b, pa.int64()), "count": pa.array(sums[i, j, b], pa.int64())})


def _lag_counts(rows: DataFrame, bin_width: int, half: int) -> DataFrame:
    """label_i, label_j, bin, count of ordered pairs up to bin `half`, in parts to be summed. rows: _seg, _t, _l, _id.

    Events of one (segment, index, label) are one row with their number, so a bucket has no more rows than indices times labels. A bucket's events look
    into it and the next one. Pairs at the same index are counted apart, in the order of ids.
    """
    rows = rows.filter("_seg is not null and _t is not null")
    width = (half + 1) * bin_width
    spans = rows.groupBy("_seg").agg(F.count(F.lit(1)).alias("n"), (F.floor((F.max("_t") - F.min("_t")) / width) + 1).alias("b"))
    n, buckets = spans.agg(F.sum("n"), F.sum("b")).first()
    width *= max(1, 4096 * (buckets or 0) // max(1, n or 0))
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    kind = dict(rows.dtypes)["_l"]
    schema = f"label_i {kind}, label_j {kind}, bin long, count long"
    at = F.floor(F.col("_t") / width)
    cells = rows.groupBy("_seg", "_t", "_l").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_bucket", F.when(F.col("_own"), at).otherwise(at - 1))
    borders = np.arange(half + 2) * bin_width

    def lagged(table: pa.Table) -> pa.Table:
        of, names = _coded(table.column("_l"))
        seg, _ = _coded(table.column("_seg"))
        bucket, t, n, own = (table.column(c).to_numpy() for c in ("_bucket", "_t", "_n", "_own"))
        order = np.lexsort((t, of, bucket, seg))
        of, seg, bucket, t, n, own = (v[order] for v in (of, seg, bucket, t, n, own.astype(bool)))
        sums = np.zeros((len(names), len(names), half + 1), np.int64)
        starts = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (bucket[1:] != bucket[:-1])])
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(t)], strict=True):
            mine = np.flatnonzero(own[begin:end]) + begin
            if not len(mine):
                continue
            first = np.flatnonzero(np.r_[True, np.diff(of[mine]) > 0])
            edges = t[mine][:, None] + borders
            edges[:, 0] += 1
            parts = np.flatnonzero(np.r_[True, np.diff(of[begin:end]) > 0]) + begin
            for a, b in zip(parts.tolist(), [*parts[1:].tolist(), end], strict=True):
                before = np.r_[0, np.cumsum(n[a:b])][np.searchsorted(t[a:b], edges)]
                sums[of[mine[first]], of[a]] += np.add.reduceat(np.diff(before, axis=1) * n[mine][:, None], first, axis=0)
        return _counted(sums, names)

    def at_once(table: pa.Table) -> pa.Table:
        of, names = _coded(table.column("_l"))
        seg, _ = _coded(table.column("_seg"))
        t, ids = table.column("_t").to_numpy(), table.column("_id").to_numpy()
        order = np.lexsort((ids, t, seg))
        of, seg, t, ids = (v[order] for v in (of, seg, t, ids))
        fresh = np.r_[True, (seg[1:] != seg[:-1]) | (t[1:] != t[:-1])]
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(t)), 0))
        smaller = np.maximum.accumulate(np.where(fresh | np.r_[True, ids[1:] != ids[:-1]], np.arange(len(t)), 0))
        sums = np.zeros((len(names), len(names), 1), np.int64)
        for i in range(len(names)):
            before = np.r_[0, np.cumsum(of == i)]
            sums[i, :, 0] = np.bincount(of, before[smaller] - before[begin], len(names)).astype(np.int64)
        return _counted(sums, names)

    apart = cells.withColumn("_part", F.pmod(F.xxhash64("_seg", "_bucket"), F.lit(tasks))).repartition(tasks, "_part").groupBy("_part").applyInArrow(lagged, schema)
    ties = rows.filter("_id is not null").select("_seg", "_t", "_l", "_id", F.pmod(F.xxhash64("_seg", "_t"), F.lit(max(tasks, (n or 0) // 200_000))).alias("_part"))
    return apart.unionByName(ties.groupBy("_part").applyInArrow(at_once, schema))


def cross_correlograms(events: DataFrame, index: str, label: str, segment: str, id_col: str, sample_rate: float, window_size: float = 0.1, bin_size: float = 0.001, labels: DataFrame | None = None, symmetrize: bool = False, dense: bool = True) -> DataFrame:
    """(label_i, label_j, bin, count) of ordered pairs, i before j, of the same segment.

    Counts, not pairs: within (segment, bucket) each label's running count is looked up at the borders of bins. Events at the same index are ordered by id. Bin 0 of a label with itself is empty.
    With symmetrize, bins run from -half to half: the count at -b of (i, j) is that at b of (j, i), and bin 0 is the larger of the two.
    """
    bin_width = int(sample_rate * min(max(bin_size, 1e-5), 1e5))
    half = (2 * int(0.5 * min(max(window_size, 1e-5), 1e5) / min(max(bin_size, 1e-5), 1e5)) + 1) // 2
    rows = events.select(F.col(segment).alias("_seg"), F.col(index).alias("_t"), F.col(label).alias("_l"), F.col(id_col).alias("_id"))
    if labels is not None:
        rows = rows.join(F.broadcast(labels.select(F.col(label).alias("_l")).distinct()), "_l", "left_semi")
    found = _lag_counts(rows, bin_width, half).groupBy("label_i", "label_j", "bin").agg(F.sum("count").alias("count"))
    found = found.filter("bin <> 0 or label_i <> label_j")
    first = 0
    if symmetrize:
        turned = found.select(F.col("label_j").alias("label_i"), F.col("label_i").alias("label_j"), (-F.col("bin")).alias("bin"), "count")
        found = found.unionByName(turned).groupBy("label_i", "label_j", "bin").agg(F.max("count").alias("count"))
        first = -half
    if not dense:
        return found
    known = rows.select("_l").distinct()
    keys = known.select(F.col("_l").alias("label_i")).crossJoin(known.select(F.col("_l").alias("label_j")))
    return dense_bins(found, keys, "bin", first, half, "count")


def collisions(events: DataFrame, index: str, label: str, segment: str, id_col: str, within: int) -> DataFrame:
    """Events with a neighbour in the same segment closer than `within` samples, both of valid labels."""
    order = Window.partitionBy(segment).orderBy(index, id_col)
    valid = events.filter(F.col(label) >= 0)
    gap = F.least(F.col(index) - F.lag(index).over(order), F.lead(index).over(order) - F.col(index))
    return valid.withColumn("_gap", gap).filter(F.col("_gap") < within).drop("_gap")


def seek(events: DataFrame, index: str, start: int, stop: int) -> DataFrame:
    """Events of [start, stop), counted from start (P09). The filter reaches the scan."""
    return events.filter((F.col(index) >= start) & (F.col(index) < stop)).withColumn(index, F.col(index) - start)


def inside_borders(events: DataFrame, index: str, segment: str, width: int, lengths: DataFrame) -> DataFrame:
    """Events further than width from either end of their segment (P06). lengths: one row per segment."""
    return events.join(lengths, segment).filter((F.col(index) > width) & (F.col(index) < F.col("length") - width)).drop("length")


def mark_aliens(peaks: DataFrame, amplitude: str, label: str, threshold: float | None, sign: str = "-", alien: int = -9) -> DataFrame:
    """Label peaks beyond an amplitude (P05). No threshold, a negative one or NaN marks nothing."""
    if threshold is None or not threshold >= 0:
        return peaks
    beyond = F.col(amplitude) >= threshold if sign == "+" else F.col(amplitude) <= -threshold
    return peaks.withColumn(label, F.when(beyond, F.lit(alien)).otherwise(F.col(label)))


def mark_aliens_by_waveform(waves: DataFrame, wave: str, label: str, threshold: float, alien: int = -9) -> DataFrame:
    """Label peaks whose waveform exceeds the threshold anywhere, on either side."""
    return waves.withColumn(label, F.when(F.exists(wave, lambda x: F.abs(x) > threshold), F.lit(alien)).otherwise(F.col(label)))


def relabel_to_cells(events: DataFrame, clusters: DataFrame, label: str = "cluster_label", cell: str = "cell_label") -> DataFrame:
    """Cluster labels replaced by cell labels, all at once; labels without a cluster stay."""
    look = clusters.select(label, F.col(cell).alias("_cell"))
    return events.join(look, label, "left").withColumn(label, F.coalesce("_cell", label)).drop("_cell")


def rates(events: DataFrame, time: str, interval: str, refresh: str, *keys: str) -> DataFrame:
    """Events per key in sliding windows (R04); the same expression runs on batch and streaming frames."""
    return events.groupBy(F.window(time, interval, refresh), *keys).agg(F.count(F.lit(1)).alias("n"))


def peak_rows(peaks: DataFrame, sample_rate: float, visible: DataFrame | None = None) -> DataFrame:
    """Rows of a peak list (G01): id, segment, time in s, label, channel, amplitude; visible labels only."""
    shown = peaks if visible is None else peaks.join(F.broadcast(visible), "cluster_label", "left_semi")
    return shown.select("peak_id", "segment", (F.col("index") / sample_rate).alias("time"), "cluster_label", "channel", "extremum_amplitude")
