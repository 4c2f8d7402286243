"""The test tables seen as recordings, event trains and waveforms; for Spark and, as text, for the SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Waveforms of 16 samples by 4 channels, sample-major.
WIDTH, CHANNELS = 16, 4

TRAIN = """train AS (SELECT event_id AS peak_id, CAST(user_id % 2 AS INT) AS segment, epoch_us(ts) // 1000000 AS "index", CAST(user_id % 16 AS INT) AS channel,
    user_id % 6 AS cluster_label, value - 250 AS extremum_amplitude FROM events)"""
SIGNAL = "signal AS (SELECT CAST(event_id // 4096 AS INT) AS segment, (event_id % 4096) // 8 AS sample, CAST(event_id % 8 AS INT) AS channel, value - 245 AS value FROM events)"
LONG = "long AS (SELECT vec_id, label, CAST((i - 1) // 4 AS INT) AS \"offset\", CAST((i - 1) % 4 AS INT) AS channel, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(i))"
CLUSTERS = """clusters AS (SELECT n_nationkey::BIGINT AS cluster_label, n_regionkey::BIGINT AS cell_label, (n_nationkey * 7 % 25 - 12)::DOUBLE AS extremum_amplitude, (n_nationkey % 16)::BIGINT AS extremum_channel,
    (n_nationkey * 11 % 25)::DOUBLE AS waveform_rms FROM nation)"""


def train(spark: SparkSession, d: str) -> DataFrame:
    """events as an event train: index in seconds, users as channels and clusters."""
    index = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_id").alias("peak_id"), (F.col("user_id") % 2).cast("int").alias("segment"), F.floor(index / 1_000_000).alias("index"), (F.col("user_id") % 16).cast("int").alias("channel"),
        (F.col("user_id") % 6).alias("cluster_label"), (F.col("value") - 250).alias("extremum_amplitude"),
    )


def signal(spark: SparkSession, d: str) -> DataFrame:
    """events as a recording of 8 channels in segments of 512 samples."""
    i = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.floor(i / 4096).cast("int").alias("segment"), F.floor((i % 4096) / 8).alias("sample"), (i % 8).cast("int").alias("channel"), (F.col("value") - 245).alias("value"),
    )


def probe(spark: SparkSession) -> DataFrame:
    """A line of 8 sites at 50 um."""
    return spark.range(8).select(F.lit(0).alias("chan_grp"), F.col("id").cast("int").alias("pos"), F.col("id").cast("int").alias("channel"), F.lit(0.0).alias("x"), (F.col("id") * 50.0).alias("y"))


def waves(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("wf"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """nation as a cluster table, regions as cells."""
    n = F.col("n_nationkey")
    return spark.read.parquet(f"{d}/nation.parquet").select(
        n.cast("long").alias("cluster_label"), F.col("n_regionkey").cast("long").alias("cell_label"), (n * 7 % 25 - 12).cast("double").alias("extremum_amplitude"), (n % 16).cast("long").alias("extremum_channel"),
        (n * 11 % 25).cast("double").alias("waveform_rms"),
    )


def round_all(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
