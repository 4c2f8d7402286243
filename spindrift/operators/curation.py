"""Edits of cluster labels: each returns a new version of the tables, none changes one in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_sizes(peaks: DataFrame, label: str = "cluster_label") -> DataFrame:
    return peaks.groupBy(label).agg(F.count(F.lit(1)).alias("nb_peak"))


def rebuild_clusters(peaks: DataFrame, old: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Cluster rows from the labels in use; what old rows knew about a label is carried over, cell_label defaults to the label."""
    carried = [c for c in old.columns if c not in (label, "nb_peak")]
    out = label_sizes(peaks.filter(F.col(label) >= 0), label).join(old.select(label, *carried), label, "left")
    return out.withColumn("cell_label", F.coalesce("cell_label", label)) if "cell_label" in carried else out.withColumn("cell_label", F.col(label))


def trash_small(peaks: DataFrame, minimum: int, label: str = "cluster_label", trash: int = -1) -> DataFrame:
    """Labels of clusters with at most `minimum` peaks become trash (K19). Sizes are aggregated and joined back: no window over a whole cluster."""
    small = label_sizes(peaks, label).filter((F.col("nb_peak") <= minimum) & (F.col(label) >= 0)).select(label, F.lit(True).alias("_small"))
    return peaks.join(small, label, "left").withColumn(label, F.when(F.col("_small"), F.lit(trash)).otherwise(F.col(label))).drop("_small")


def trash_low(peaks: DataFrame, clusters: DataFrame, minimum: float, label: str = "cluster_label", trash: int = -1) -> DataFrame:
    """Labels of clusters whose extremum is below `minimum` become trash."""
    low = clusters.filter(F.abs("extremum_amplitude") < minimum).select(label, F.lit(True).alias("_low"))
    return peaks.join(low, label, "left").withColumn(label, F.when(F.col("_low"), F.lit(trash)).otherwise(F.col(label))).drop("_low")


def trash_misaligned(peaks: DataFrame, extremes: DataFrame, n_left: int, maximum_shift: int = 2, label: str = "cluster_label", trash: int = -1) -> DataFrame:
    """Trash clusters whose centroid's extremum (label, offset) lies more than maximum_shift from the peak."""
    off = extremes.filter(F.abs(F.lit(-n_left) - F.col("offset")) > maximum_shift).select(label, F.lit(True).alias("_off"))
    return peaks.join(off, label, "left").withColumn(label, F.when(F.col("_off"), F.lit(trash)).otherwise(F.col(label))).drop("_off")


def relabel(peaks: DataFrame, pairs: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Labels replaced through a small table (old, new), all at once."""
    look = pairs.select(F.col("old").alias(label), F.col("new").alias("_new"))
    return peaks.join(look, label, "left").withColumn(label, F.coalesce("_new", label)).drop("_new")


def merge(peaks: DataFrame, labels: list[int], label: str = "cluster_label") -> DataFrame:
    """A set of labels becomes its smallest, or a new label where that is negative."""
    target = min(labels)
    if target < 0:
        target = new_label(peaks, label)
    return peaks.withColumn(label, F.when(F.col(label).isin(labels), F.lit(target)).otherwise(F.col(label)))


def new_label(peaks: DataFrame, label: str = "cluster_label") -> int:
    """One more than the largest label in use."""
    top = peaks.agg(F.max(label)).first()[0]
    return max(-1 if top is None else top, -1) + 1


def set_label(peaks: DataFrame, chosen: DataFrame, value: int, id_col: str = "peak_id", label: str = "cluster_label") -> DataFrame:
    """Label of the chosen peaks (K21: change by mask, split off, move to trash)."""
    mark = chosen.select(id_col).distinct().withColumn("_chosen", F.lit(True))
    return peaks.join(mark, id_col, "left").withColumn(label, F.when(F.col("_chosen"), F.lit(value)).otherwise(F.col(label))).drop("_chosen")


def tag_same_cell(clusters: DataFrame, labels: list[int]) -> DataFrame:
    """Chosen clusters get the smallest of their labels as cell."""
    return clusters.withColumn("cell_label", F.when(F.col("cluster_label").isin(labels), F.lit(min(labels))).otherwise(F.col("cell_label")))


def set_attribute(clusters: DataFrame, label: int, **values) -> DataFrame:
    """Tag (16 characters), annotation (32) or colour of one cluster."""
    limits = {"tag": 16, "annotations": 32}
    for name, value in values.items():
        new = F.lit(value[: limits[name]] if name in limits else value)
        clusters = clusters.withColumn(name, F.when(F.col("cluster_label") == label, new).otherwise(F.col(name)))
    return clusters


def order_clusters(clusters: DataFrame, by: str = "waveform_rms") -> DataFrame:
    """cluster rows with new_label, 0 for the largest |by|, and new_cell, the first new label of each cell (K23). Ties: smaller old label first."""
    rank = F.row_number().over(Window.orderBy(F.desc(F.abs(F.col(by))), "cluster_label")) - 1
    ranked = clusters.withColumn("new_label", rank.cast("long"))
    return ranked.withColumn("new_cell", F.min("new_label").over(Window.partitionBy("cell_label")))


def merge_pairs(pairs: DataFrame) -> DataFrame:
    """(old, new) for labels joined by similar pairs (label_i, label_j), each to the smallest of its component (K20). Cluster-size tables."""
    now = pairs.select(F.greatest("label_i", "label_j").alias("old"), F.least("label_i", "label_j").alias("new")).groupBy("old").agg(F.min("new").alias("new"))
    while True:
        up = now.select(F.col("old").alias("new"), F.col("new").alias("_top"))
        step = now.join(up, "new", "left").select("old", F.coalesce("_top", "new").alias("_next"), F.col("_top").isNotNull().alias("_moved")).checkpoint()
        now = step.select("old", F.col("_next").alias("new"))
        if step.filter("_moved").isEmpty():
            break
    links = pairs.select(F.col("label_i").alias("a"), F.col("label_j").alias("b"))
    root = now.select(F.col("old").alias("a"), F.col("new").alias("_ra"))
    both = links.join(root, "a", "left").join(now.select(F.col("old").alias("b"), F.col("new").alias("_rb")), "b", "left")
    cross = both.select(F.coalesce("_ra", "a").alias("label_i"), F.coalesce("_rb", "b").alias("label_j")).filter("label_i <> label_j").distinct().checkpoint()
    if cross.isEmpty():
        return now
    more = merge_pairs(cross)
    out = now.join(more.select(F.col("old").alias("new"), F.col("new").alias("_top")), "new", "left").select("old", F.coalesce("_top", "new").alias("new"))
    return out.unionByName(more.join(out, "old", "left_anti")).distinct()


def sampler_labels(peaks: DataFrame, sampled: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Labels after sampling: sampled peaks 0, others -11, aliens stay -9."""
    mark = sampled.select("peak_id").distinct().withColumn("_in", F.lit(True))
    new = F.when(F.col(label) == -9, F.lit(-9)).when(F.col("_in"), F.lit(0)).otherwise(F.lit(-11))
    return peaks.join(mark, "peak_id", "left").withColumn(label, new.cast("long")).drop("_in")


def ensure_checkpoint_dir(spark) -> None:
    """Use spark.checkpoint.dir where it is set; a temporary folder only on a single machine."""
    import tempfile

    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spindrift-"))
