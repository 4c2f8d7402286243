"""Recordings in raw interleaved binary files, as a Spark data source; probe descriptions; in-memory recordings."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Registered source classes by name.
SOURCES: dict[str, type] = {}


def register_source(cls: type) -> type:
    SOURCES[cls.name()] = cls
    return cls


class Span(InputPartition):
    def __init__(self, path: str, segment: int, start: int, stop: int):
        self.path, self.segment, self.start, self.stop = path, segment, start, stop


@register_source
class RawSignalSource(DataSource):
    """format("rawsignal"): sample-major interleaved numbers, one file per segment.

    Options: paths (comma-separated), dtype, total_channel, sample_rate, offset (bytes), chunk (samples per partition), channels
    (comma-separated projection, kept in the order given). Each partition reads its own byte range, so a long file is split.
    """

    @classmethod
    def name(cls) -> str:
        return "rawsignal"

    def schema(self) -> str:
        return "segment int, sample long, v array<float>"

    def reader(self, schema) -> DataSourceReader:
        return RawSignalReader(self.options)


class RawSignalReader(DataSourceReader):
    def __init__(self, options: dict):
        get = options.get
        self.paths = [p for p in (get("paths") or get("path") or "").split(",") if p]
        self.dtype, self.width = np.dtype(get("dtype", "int16")), int(get("total_channel"))
        self.offset, self.chunk = int(get("offset", "0")), int(get("chunk", "65536"))
        self.channels = [int(c) for c in get("channels", "").split(",") if c != ""]

    def partitions(self) -> list[Span]:
        import os

        spans, row = [], self.dtype.itemsize * self.width
        for segment, path in enumerate(self.paths):
            size = os.path.getsize(path) - self.offset
            if size % row:
                raise ValueError(f"{path}: {size} bytes are no whole number of samples of {self.width} channels")
            n = size // row
            spans += [Span(path, segment, a, min(n, a + self.chunk)) for a in range(0, n, self.chunk)]
        return spans

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        count = (span.stop - span.start) * self.width
        data = np.fromfile(span.path, self.dtype, count, offset=self.offset + span.start * self.width * self.dtype.itemsize).reshape(-1, self.width)
        if self.channels:
            data = data[:, self.channels]
        n, width = data.shape
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(data, np.float32).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, span.segment, np.int32)), pa.array(np.arange(span.start, span.stop)), lists], ["segment", "sample", "v"])


def read_raw(spark: SparkSession, paths: list[str], dtype: str, total_channel: int, offset: int = 0, channels: list[int] | None = None, chunk: int = 65536) -> DataFrame:
    """Frames (segment, sample, v) of files that driver and executors can open."""
    spark.dataSource.register(RawSignalSource)
    return spark.read.format("rawsignal").options(paths=",".join(paths), dtype=dtype, total_channel=total_channel, offset=offset, chunk=chunk, channels=",".join(map(str, channels or []))).load()


def read_raw_store(spark: SparkSession, glob: str, dtype: str, total_channel: int, offset: int = 0) -> DataFrame:
    """The same through Spark's binaryFile reader, for stores that only Spark opens; segments are numbered by path. A file is one task."""
    files = spark.read.format("binaryFile").load(glob)
    order = files.select("path").distinct().orderBy("path").rdd.map(lambda r: r[0]).zipWithIndex().toDF(["path", "segment"])
    row = np.dtype(dtype).itemsize * total_channel

    def run(batches):
        for batch in batches:
            for content, segment in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8)[offset:]
                if data.size % row:
                    raise ValueError(f"segment {segment} is no whole number of samples")
                data = data.view(dtype).reshape(-1, total_channel).astype(np.float32)
                for a in range(0, len(data), 65536):
                    part = data[a : a + 65536]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * total_channel), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), segment, np.int32)), pa.array(np.arange(a, a + len(part))), lists], ["segment", "sample", "v"])

    return files.join(F.broadcast(order), "path").select("content", F.col("segment").cast("int")).mapInArrow(run, "segment int, sample long, v array<float>")


def from_arrays(spark: SparkSession, arrays: list[np.ndarray]) -> DataFrame:
    """An in-memory recording, one (sample, channel) array per segment."""
    tables = []
    for segment, data in enumerate(arrays):
        n, width = data.shape
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(data, np.float32).ravel()))
        tables.append(pa.table({"segment": pa.array(np.full(n, segment, np.int32)), "sample": pa.array(np.arange(n)), "v": lists}))
    return spark.createDataFrame(pa.concat_tables(tables))


def to_long(frames: DataFrame, channels: list[int] | None = None) -> DataFrame:
    """segment, sample, channel, value."""
    out = frames.select("segment", "sample", F.posexplode("v").alias("channel", "value")).withColumn("value", F.col("value").cast("double"))
    return out if channels is None else out.filter(F.col("channel").isin(channels))


def to_frames(long: DataFrame) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct("channel", "value")))
    return long.groupBy("segment", "sample").agg(F.transform(cells, lambda c: c["value"].cast("float")).alias("v"))


def parse_probe(text: str) -> dict:
    """The channel groups of a probe file: one literal assignment, never executed."""
    for node in ast.parse(text).body:
        if isinstance(node, ast.Assign) and getattr(node.targets[0], "id", "") == "channel_groups":
            return ast.literal_eval(_spelled_out(node.value))
    raise ValueError("no channel_groups in the probe file")


class _Ranges(ast.NodeTransformer):
    """range(...) and list(range(...)) of literals become lists."""

    def visit_Call(self, node: ast.Call):
        self.generic_visit(node)
        name = getattr(node.func, "id", "")
        if name == "range":
            values = list(range(*map(ast.literal_eval, node.args)))
            return ast.List([ast.Constant(x) for x in values], ast.Load())
        if name == "list" and len(node.args) == 1 and isinstance(node.args[0], (ast.List, ast.Tuple)):
            return node.args[0]
        raise ValueError("only literals and range() may stand in a probe file")


def _spelled_out(node: ast.AST) -> ast.AST:
    return ast.fix_missing_locations(_Ranges().visit(node))


def format_probe(groups: dict) -> str:
    return f"channel_groups = {groups!r}\n"


def probe_table(spark: SparkSession, groups: dict) -> DataFrame:
    """probe rows of channel groups; groups without geometry get the default one."""
    from ..operators.detect import default_geometry

    frames = []
    for group, entry in groups.items():
        channels, places = list(entry["channels"]), entry.get("geometry")
        if places is None:
            frames.append(default_geometry(spark, group, channels))
            continue
        if any(len(places[c]) != 2 for c in channels):
            raise ValueError("geometry is two-dimensional")
        frames.append(spark.createDataFrame([(group, i, c, float(places[c][0]), float(places[c][1])) for i, c in enumerate(channels)], "chan_grp int, pos int, channel int, x double, y double"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def neo_reader(name: str):
    """Vendor formats go through an optional library."""
    try:
        import neo.rawio as rawio
    except ImportError as e:
        raise NotImplementedError(f"{name}: vendor formats need the neo library") from e
    return getattr(rawio, f"{name}RawIO")
