"""Pruning shears on whole tables (K13): channel after channel, each reduced and clustered as a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clustering, leaves
from .features import global_svd
from .graph import saved

#: Rows that are clustered on matrices: 128 MB each. More are clustered on leaves.
SAMPLE = 4096
#: Free peaks that one task visits by itself.
PEAKS = 1 << 17
#: Reduced rows that one task clusters.
REDUCED = 1 << 19


def pruning_shears_table(peaks: DataFrame, id_col: str, vec: str, channel_of: np.ndarray, peak_channel: str, amplitude: str, adjacent: np.ndarray, min_cluster_size: int = 20, nb_max: int = 1000, n_components: int = 3, sample: int = SAMPLE, peaks_at_once: int = PEAKS, reduced_at_once: int = REDUCED) -> DataFrame:
    """(id, cluster_label), the labels of clustering.pruning_shears for any number of rows; -1 is what no channel has kept.

    A visit's percentiles and Gram matrix are made by Spark, its clusters in one task or, of more than `reduced_at_once` rows, by Spark; the driver sees a row a channel.
    When at most `peaks_at_once` peaks are free the rest of the visits takes one task. More than `sample` rows are clustered without a matrix, with the labels of the table.
    """

    def cluster(x: np.ndarray, least: int) -> np.ndarray:
        return (clustering.hdbscan if len(x) <= sample else leaves.hdbscan)(x, least)

    cols = [F.col(vec).cast("array<double>").alias("_x"), F.col(peak_channel).cast("long").alias("_peak"), F.col(amplitude).cast("double").alias("_amp")]
    free = saved(peaks.select(F.col(id_col), *cols), "free")
    kept, tired, current = [], set(), 0
    left = free.count()
    visits, gave_none = 0, {}
    while visits < nb_max and left > max(sample, peaks_at_once):
        visits += 1
        seen = free.groupBy("_peak").agg(F.count(F.lit(1)).alias("n"), F.percentile("_amp", F.lit(0.9)).alias("top")).orderBy("_peak").collect()
        open_ = [(r["top"], r["_peak"]) for r in seen if r["_peak"] not in tired and r["n"] > min_cluster_size]
        if not open_:
            break
        at = max(open_, key=lambda r: r[0])[1]
        n = sum(r["n"] for r in seen if r["_peak"] is not None and adjacent[at][r["_peak"]])
        if gave_none.get(at) == n:  # its adjacent peaks are still those of that visit
            tired.add(at)
            continue
        near = free.filter(F.col("_peak").isin(np.flatnonzero(adjacent[at]).tolist()))
        own = F.array(*[F.col("_x")[i] for i in np.flatnonzero(adjacent[at][channel_of]).tolist()])
        f, _ = global_svd(near.select(id_col, own.alias("_x")), id_col, "_x", n_components)
        f = saved(f, "reduced")
        found = _clustered(f, id_col, min_cluster_size, cluster) if n <= max(sample, reduced_at_once) else clustering.find_clusters(f, id_col, "hdbscan", whole=True, min_cluster_size=min_cluster_size)
        found = saved(found.filter("cluster_label >= 0"), "visited")
        good = found.join(near, id_col).groupBy("cluster_label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_peak") == at).cast("double")).alias("share"), F.percentile("_amp", F.lit(0.5)).alias("mid"))
        best = good.filter((F.col("n") >= min_cluster_size) & (F.col("share") > 0.5)).orderBy(F.desc("mid"), "cluster_label").first()
        if best:
            taken = found.filter(F.col("cluster_label") == best["cluster_label"]).select(id_col)
        elif found.isEmpty():
            taken = near.filter(F.col("_peak") == at).select(id_col)
        else:
            tired.add(at)
            gave_none[at] = n
            continue
        taken = saved(taken, "taken")
        kept.append(taken.select(id_col, F.lit(current).cast("long").alias("cluster_label")))
        free = saved(free.join(taken, id_col, "left_anti"), "free")
        left = free.count()
        current += 1
        tired.clear()

    visits_left, next_label, tired = nb_max - visits, current, set(tired)

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        found = clustering.pruning_shears(np.stack(pdf["_x"].to_numpy()), channel_of, pdf["_peak"].to_numpy(), pdf["_amp"].to_numpy(), adjacent, min_cluster_size, visits_left, n_components, tired, cluster)
        return pd.DataFrame({id_col: pdf[id_col], "cluster_label": np.where(found >= 0, found + next_label, found)})

    kind = dict(peaks.dtypes)[id_col]
    if left <= max(sample, peaks_at_once):
        out = free.groupBy().applyInPandas(rest, f"`{id_col}` {kind}, cluster_label long")
    else:
        out = free.select(id_col, F.lit(clustering.NOISE).cast("long").alias("cluster_label"))
    for rows in kept:
        out = out.unionByName(rows)
    return out


def _clustered(reduced: DataFrame, id_col: str, least: int, cluster) -> DataFrame:
    """(id, cluster_label) of all rows, in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        return pd.DataFrame({id_col: pdf[id_col], "cluster_label": cluster(np.stack(pdf["features"].to_numpy()), least)})

    return reduced.groupBy().applyInPandas(run, f"`{id_col}` {dict(reduced.dtypes)[id_col]}, cluster_label long")
