"""Shared plumbing of the corpus operators: durable intermediates, skew-proof joins, word boundaries."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, [\x20\x09-\x0D], as a Java character class and as Python text.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

COLLECT_EVERY = 8

_own_dirs: dict[str, str] = {}
_writes = itertools.count(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset a temporary folder stands in, which only a single-machine master can see;
    on any other master that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut lineage: write df to the shared folder as Parquet and read it back.

    A lost executor costs a re-read of those files, not a recomputation of what led to them. Spark drops the shuffle files and broadcast
    blocks of plans that are gone only when the driver's garbage is collected, so that is asked for once in a while.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spindrift/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if next(_writes) % COLLECT_EVERY == 0:
        spark._jvm.java.lang.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that materialise has written, once all that was made of it is written too."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_materialised(spark: SparkSession) -> bool:
    """Remove all that materialise has written to the shared folder; for when no frame that was made of it is in use any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/spindrift")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skew_join(left: DataFrame, right: DataFrame, key: str, rows: int, size_col: str, hot_share: int = 1000) -> DataFrame:
    """Inner join of left with right (one row per key), safe for keys that hold much of left.

    size_col of right counts the left rows of a key. Keys above rows / hot_share of them number
    fewer than hot_share, so broadcasting their rows is bounded whatever the input; all other
    keys are small enough for an ordinary shuffle.
    """
    hot_at = max(1000, rows // hot_share)
    hot = right.filter(F.col(size_col) > hot_at)
    cold = right.filter(F.col(size_col) <= hot_at)
    near = left.join(F.broadcast(hot), key)
    far = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)


def small_arrow_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Bound what one Arrow batch holds, for columns of whole texts.

    These options are the session's and plans are lazy, so all operators ask for the same bounds, which are only ever lowered; they
    change costs, not results.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or int(now) == 0 or int(now) > most:
            spark.conf.set(key, str(most))


def slices(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes sum to limit at most (a single larger row alone)."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if len(sizes) > begin:
        yield begin, len(sizes)


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A uniform number in (0, 1) that depends on cols and seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
