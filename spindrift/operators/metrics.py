"""Similarities of clusters, silhouettes and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import cosine_with_max, kernel


def vectors(centres: DataFrame, label: str, value: str = "median") -> DataFrame:
    """One flat vector per cluster from long-form centroids."""
    cells = F.array_sort(F.collect_list(F.struct("channel", "offset", F.col(value).alias("v"))))
    return centres.groupBy(label).agg(F.transform(cells, lambda c: c["v"]).alias("vec"))


def pairwise(vecs: DataFrame, label: str, score, all_pairs: bool = True) -> DataFrame:
    """score(vec_i, vec_j) for pairs of clusters (J06): a theta join of cluster-size tables."""
    a = vecs.select(F.col(label).alias("label_i"), F.col("vec").alias("_a"))
    b = vecs.select(F.col(label).alias("label_j"), F.col("vec").alias("_b"))
    pairs = a.crossJoin(b) if all_pairs else a.join(b, F.col("label_i") < F.col("label_j"))
    return pairs.select("label_i", "label_j", score(F.col("_a"), F.col("_b")).alias("similarity"))


def cluster_similarity(vecs: DataFrame, label: str) -> DataFrame:
    """Cosine with maximum between clusters, 1 on the diagonal."""
    out = pairwise(vecs, label, cosine_with_max)
    return out.withColumn("similarity", F.when(F.col("label_i") == F.col("label_j"), 1.0).otherwise(F.col("similarity")))


def ratio_similarity(vecs: DataFrame, label: str) -> DataFrame:
    """Similarity of shapes: each vector is first scaled by its largest magnitude."""
    top = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    return cluster_similarity(vecs.withColumn("_top", top).select(label, F.transform("vec", lambda x: F.try_divide(x, F.col("_top"))).alias("vec")), label)


def kernel_similarity(vecs: DataFrame, label: str, name: str, size: int) -> DataFrame:
    return pairwise(vecs, label, lambda a, b: kernel(name, a, b, size))


def pairs_over(similarity: DataFrame, threshold: float) -> DataFrame:
    """Pairs i < j above a threshold (A10)."""
    return similarity.filter((F.col("label_i") < F.col("label_j")) & (F.col("similarity") > threshold))


def pair_list(labels: DataFrame, label: str) -> DataFrame:
    """All pairs a < b of labels (C11)."""
    a, b = labels.select(F.col(label).alias("label_i")), labels.select(F.col(label).alias("label_j"))
    return a.join(b, F.col("label_i") < F.col("label_j"))


def label_sums(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Sums of distances from rows of a to each label of b, and from rows of b to each label of a; labels begin at at_a and at_b.

    Distances are matrix products, but where two rows are so close that these would lose digits.
    """
    mid = a.mean(0)
    a, b = a - mid, b - mid
    sa, sb = (a * a).sum(1), (b * b).sum(1)
    small = 1e-9 * max(sa.max(), sb.max())
    out, back = np.zeros((len(a), len(at_b))), np.zeros((len(at_a), len(b)))
    for begin in range(0, len(a), tile):
        rows = slice(begin, begin + tile)
        d = a[rows] @ (-2 * b.T)
        d += sa[rows, None]
        d += sb
        i, j = np.nonzero(d <= small)
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            d[p, q] = ((a[begin + p] - b[q]) ** 2).sum(1)
        np.sqrt(d, out=d)
        out[rows] = np.add.reduceat(d, at_b, axis=1)
        cuts = np.unique(np.r_[begin, at_a[(at_a > begin) & (at_a < begin + tile)]])
        back[np.searchsorted(at_a, cuts, side="right") - 1] += np.add.reduceat(d, cuts - begin, axis=0)
    return out, back.T


def silhouette(points: DataFrame, id_col: str, label: str, vec: str, piece: int = 1 << 15, max_points: int | None = None) -> DataFrame:
    """Euclidean silhouette of each point (A11): (id, label, silhouette); empty where there are fewer than two labels.

    All points are compared, so the work grows with the square of their number. They come in groups of at most about `piece` rows: pieces of a
    large label, or several small labels. Each two groups meet in one unit, which sums distances per label for both; no pair is ever a row.
    max_points: refuse more points than that.
    """
    from .graph import saved
    from .neighbours import matrix

    cols = points.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vec).alias("vec"))
    sizes = saved(cols.groupBy("label").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    if max_points is not None and total > max_points:
        raise ValueError(f"a silhouette of {total} points compares each with all, at most {max_points}: sample them first")
    piece = max(256, min(piece, total // 24))
    few = 2 * F.col("_n") <= piece
    rest = sizes.agg(F.sum(F.when(few, F.col("_n")))).first()[0] or 0
    own = F.concat_ws(":", F.lit("l"), F.xxhash64("label"), F.pmod(F.xxhash64("id", F.lit(5)), F.ceil(F.col("_n") / piece)))
    shared = F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64("label", F.lit(7)), F.lit(1 + rest // piece)))
    placed = cols.join(sizes.withColumnRenamed("label", "_l"), F.col("label").eqNullSafe(F.col("_l"))).select("id", "label", "vec", F.when(few, shared).otherwise(own).alias("_g"))
    placed = saved(placed, "placed")
    names = saved(placed.select("_g").distinct(), "groups")
    pairs = names.crossJoin(names.select(F.col("_g").alias("_h"))).filter("_g <= _h")
    left = placed.join(pairs, "_g").select("id", "label", "vec", "_g", "_h", F.lit(True).alias("_left"))
    right = placed.withColumnRenamed("_g", "_h").join(pairs.filter("_g < _h"), "_h").select("id", "label", "vec", "_g", "_h", F.lit(False).alias("_left"))
    tasks = 8 * points.sparkSession.sparkContext.defaultParallelism

    def run(table: pa.Table) -> pa.Table:
        codes = pc.dictionary_encode(table.column("label").combine_chunks(), null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        of, is_left, x = codes.indices.to_numpy(zero_copy_only=False), table.column("_left").to_numpy(zero_copy_only=False).astype(bool), matrix(table.column("vec"))
        sides = []
        for rows in (np.flatnonzero(is_left), np.flatnonzero(~is_left)):
            rows = rows[np.argsort(of[rows], kind="stable")]
            starts = np.flatnonzero(np.r_[True, of[rows][1:] != of[rows][:-1]]) if len(rows) else rows
            sides.append((rows, x[rows].astype(float), starts))
        if not len(sides[1][0]):  # a group with itself
            sides = sides[:1]
        sums = label_sums(sides[0][1], sides[-1][1], sides[0][2], sides[-1][2])
        parts = []
        for (rows, _, _), (other, _, starts), total in zip(sides, sides[::-1], sums, strict=False):
            n = np.diff(np.r_[starts, len(other)])
            for k, start in enumerate(starts.tolist()):
                take = pa.array(rows)
                to = table.column("label").take(pa.array(np.full(len(rows), other[start])))
                parts.append(pa.table([table.column("id").take(take), table.column("label").take(take), to, pa.array(total[:, k]), pa.array(np.full(len(rows), n[k], np.int64))], ["id", "label", "to", "total", "n"]))
        return pa.concat_tables(parts)

    kind = dict(cols.dtypes)
    units = left.unionByName(right).repartition(tasks, "_g", "_h").groupBy("_g", "_h")
    sums = units.applyInArrow(run, f"id {kind['id']}, label {kind['label']}, to {kind['label']}, total double, n long")
    sums = sums.groupBy("id", "label", "to").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    inner = F.max(F.when((F.col("label") == F.col("to")) & (F.col("n") > 1), F.col("total") / (F.col("n") - 1)))
    outer = F.min(F.when(F.col("label") != F.col("to"), F.col("total") / F.col("n")))
    out = sums.groupBy("id", "label").agg(inner.alias("_a"), outer.alias("_b")).filter("_b is not null")
    value = F.when(F.col("_a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label), value.alias("silhouette"))


def silhouette_by_label(scores: DataFrame, label: str) -> DataFrame:
    """Sorted silhouettes and their mean per label."""
    return scores.groupBy(label).agg(F.sort_array(F.collect_list("silhouette"), asc=False).alias("silhouettes"), F.avg("silhouette").alias("mean"))


def cluster_report(clusters: DataFrame, channels: DataFrame, mads: DataFrame, spikes: DataFrame, bit_to_microvolt: float) -> DataFrame:
    """Per cluster: channel, amplitude in MAD and microvolts, spikes."""
    n = spikes.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("nb_spike"))
    out = clusters.join(n, "cluster_label", "left").join(channels.select(F.col("channel").alias("extremum_channel"), "pos"), "extremum_channel", "left").join(mads.select(F.col("channel").alias("extremum_channel"), "mad"), "extremum_channel", "left")
    return out.select("cluster_label", "cell_label", "extremum_channel", F.col("pos").alias("local_channel"), "extremum_amplitude", (F.col("extremum_amplitude") * F.col("mad") * bit_to_microvolt).alias("amplitude_uv"), F.coalesce("nb_spike", F.lit(0)).alias("nb_spike"))


def noise_report(mads: DataFrame, threshold: float, bit_to_microvolt: float) -> DataFrame:
    """Least, largest and mean noise in microvolts, and the threshold there."""
    uv = F.col("mad") * bit_to_microvolt
    return mads.agg(F.min(uv).alias("min_uv"), F.max(uv).alias("max_uv"), F.avg(uv).alias("mean_uv"), (F.avg(uv) * threshold).alias("threshold_uv"))


def nearest(points: DataFrame, x: Column, y: Column, at: tuple[float, float], id_col: str) -> DataFrame:
    """The point closest to a click."""
    d = (x - F.lit(at[0])) * (x - F.lit(at[0])) + (y - F.lit(at[1])) * (y - F.lit(at[1]))
    return points.withColumn("distance2", d).orderBy("distance2", id_col).limit(1)


def running_share(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Cumulative sum within keys."""
    return df.withColumn("running", F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def overlaps(centres: DataFrame, label: str, reach: int, value: str = "median") -> DataFrame:
    """For each cluster the pair of others, and their shift, whose sum is closest to it (J07): label, first, second, shift, distance.

    A triple theta join of cluster-size tables with a sequence of shifts.
    """
    v = centres.select(label, "offset", "channel", F.col(value).alias("_v"))
    names = v.select(label).distinct()
    a, b, c = names.select(F.col(label).alias("first")), names.select(F.col(label).alias("second")), names.select(F.col(label).alias("whole"))
    triples = a.join(b, F.col("first") <= F.col("second")).crossJoin(c).filter("whole <> first and whole <> second").withColumn("shift", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    cells = triples.join(v.select(F.col(label).alias("whole"), "offset", "channel", F.col("_v").alias("_w")), "whole")
    cells = cells.join(v.select(F.col(label).alias("first"), "offset", "channel", F.col("_v").alias("_x")), ["first", "offset", "channel"])
    cells = cells.withColumn("_o", F.col("offset") - F.col("shift")).join(v.select(F.col(label).alias("second"), F.col("offset").alias("_o"), "channel", F.col("_v").alias("_y")), ["second", "_o", "channel"], "left")
    gap = F.abs(F.col("_w") - F.col("_x") - F.coalesce("_y", F.lit(0.0)))
    dist = cells.groupBy("whole", "first", "second", "shift").agg(F.max(gap).alias("distance"))
    best = dist.groupBy("whole").agg(F.min(F.struct(F.round("distance", 9).alias("distance"), "first", "second", "shift")).alias("b"))
    return best.select(F.col("whole").alias(label), "b.first", "b.second", "b.shift", "b.distance")
