"""A named table store with snapshots, and the bound data set of a work folder."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TableStore:
    """Named tables below a folder of any store that Spark writes: create, append, overwrite slices, annotate, snapshot.

    Each table is a folder of versions with a manifest row naming the current one; a version is never changed once it is current,
    so readers of an older one are not disturbed. Appends add files to the current version.
    """

    MANIFEST = "name string, version string, annotations string, at long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _entries(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        rows = self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/_manifest")
        return rows.groupBy("name").agg(F.max_by(F.struct("version", "annotations"), "at").alias("e"), F.max("at").alias("at")).select("name", "e.*", "at")

    def _entry(self, name: str):
        found = self._entries()
        return None if found is None else found.filter(F.col("name") == name).first()

    def _record(self, name: str, version: str | None, annotations: str) -> None:
        found = self._entries()
        at = 1 + ((found.agg(F.max("at")).first()[0] or 0) if found is not None else 0)
        self.spark.createDataFrame([(name, version, annotations, at)], self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/_manifest")

    def keys(self) -> list[str]:
        found = self._entries()
        return [] if found is None else sorted(r[0] for r in found.filter("version is not null").collect())

    def has(self, name: str) -> bool:
        return name in self.keys()

    def put(self, name: str, df: DataFrame, partition_by: list[str] | None = None, **annotations) -> DataFrame:
        """Create or replace a table."""
        version = uuid.uuid4().hex
        df.write.partitionBy(*(partition_by or [])).parquet(f"{self.path}/{name}/{version}")
        self._record(name, version, json.dumps(annotations))
        return self.get(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        entry = self._entry(name)
        if entry is None or entry["version"] is None:
            return self.put(name, df)
        df.write.mode("append").parquet(f"{self.path}/{name}/{entry['version']}")
        return self.get(name)

    def overwrite_where(self, name: str, df: DataFrame, replaced) -> DataFrame:
        """Replace the rows for which `replaced` holds by df (S11): a new version without them."""
        kept = self.get(name).filter(~F.coalesce(replaced, F.lit(False)))
        return self.put(name, kept.unionByName(df), **self.annotations(name))

    def get(self, name: str) -> DataFrame:
        entry = self._entry(name)
        if entry is None or entry["version"] is None:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/{name}/{entry['version']}")

    def delete(self, name: str) -> None:
        self._record(name, None, "{}")

    def annotate(self, name: str, **annotations) -> None:
        entry = self._entry(name)
        self._record(name, entry["version"], json.dumps({**json.loads(entry["annotations"]), **annotations}))

    def annotations(self, name: str) -> dict:
        entry = self._entry(name)
        if entry is None:
            raise KeyError(name)
        return json.loads(entry["annotations"])

    def savepoint(self, name: str) -> dict[str, str]:
        """Name the current versions of all tables (S16); versions are immutable but for appends, so nothing is copied."""
        now = {r["name"]: r["version"] for r in self._entries().filter("version is not null").collect()}
        self._record(f"savepoint:{name}", json.dumps(now), "{}")
        return now

    def restore(self, name: str) -> None:
        for table, version in json.loads(self._entry(f"savepoint:{name}")["version"]).items():
            self._record(table, version, "{}")


def processed_length(processed: DataFrame) -> DataFrame:
    """How far each segment is processed."""
    return processed.groupBy("segment").agg((F.max("sample") + 1).alias("processed_length"))


def spikes_between(spikes: DataFrame, segment: int, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Spikes of one segment by sample range (S13); the filter reaches the scan."""
    out = spikes.filter(F.col("segment") == segment)
    if start is not None:
        out = out.filter(F.col("index") >= start)
    return out if stop is None else out.filter(F.col("index") < stop)
