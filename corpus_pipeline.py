"""A corpus pipeline: its stages, each written and read again between two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import stages
from spindrift.llm.common import materialise

STAGES = stages.STAGES
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
