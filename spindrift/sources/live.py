"""A live recording as a Spark stream (S29): raw files that grow while they are recorded, or finished ones replayed at the rate they were taken."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from .raw import RawSignalReader, Span, register_source


@register_source
class LiveSignalSource(DataSource):
    """format("livesignal"): the frames of format("rawsignal") as a stream, with its options, and:

    origin (epoch seconds) and sample_rate: sample k of the recording is there from origin + k / sample_rate on, segments one behind the other.
    Without an origin all whole samples that the files hold are there. Offsets are samples of each file, so a stream goes on from its checkpoint
    where it was, whatever was recorded meanwhile. Files may be missing or empty at first; a sample that is written in part waits for its rest.
    """

    @classmethod
    def name(cls) -> str:
        return "livesignal"

    def schema(self) -> str:
        return "segment int, sample long, v array<float>"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LiveSignalReader(self.options)


class LiveSignalReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.raw = RawSignalReader(options)
        self.rate, self.origin = float(options.get("sample_rate", "0")), float(options.get("origin", "nan"))
        if self.origin == self.origin and self.rate <= 0:
            raise ValueError("a replay from an origin on needs a sample_rate")

    def _there(self) -> list[int]:
        """Whole samples of each file that are there by now."""
        row = self.raw.dtype.itemsize * self.raw.width
        sizes = [max(0, os.path.getsize(p) - self.raw.offset) // row if os.path.exists(p) else 0 for p in self.raw.paths]
        if self.origin != self.origin:
            return sizes
        left = max(0, int((time.time() - self.origin) * self.rate))
        out = []
        for n in sizes:
            out.append(min(n, left))
            left -= out[-1]
        return out

    def initialOffset(self) -> dict:
        return {str(i): 0 for i in range(len(self.raw.paths))}

    def latestOffset(self) -> dict:
        return {str(i): n for i, n in enumerate(self._there())}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        step = self.raw.chunk
        spans = []
        for segment, path in enumerate(self.raw.paths):
            a, b = int(start.get(str(segment), 0)), int(end.get(str(segment), 0))
            spans += [Span(path, segment, i, min(b, i + step)) for i in range(a, b, step)]
        return spans

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.raw.read(partition)

    def commit(self, end: dict) -> None:
        """Files stay as they are; nothing is to be let go."""


def read_live(spark: SparkSession, paths: list[str], dtype: str, total_channel: int, sample_rate: float | None = None, origin: float | None = None, offset: int = 0, channels: list[int] | None = None, chunk: int = 65536) -> DataFrame:
    """A stream of frames (segment, sample, v) of files that driver and executors can open."""
    spark.dataSource.register(LiveSignalSource)
    options = {"paths": ",".join(paths), "dtype": dtype, "total_channel": total_channel, "offset": offset, "chunk": chunk, "channels": ",".join(map(str, channels or []))}
    if origin is not None:
        options |= {"origin": repr(float(origin)), "sample_rate": repr(float(sample_rate or 0))}
    return spark.readStream.format("livesignal").options(**options).load()
