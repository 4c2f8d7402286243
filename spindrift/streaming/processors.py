"""Structured Streaming versions of the stateful operators; their kernels are those of the batch operators.

Input rows are chunks of a segment: segment, i_start (first sample), channels, v (the frames of the chunk, one behind the other). Chunks may arrive out of order: a chunk
that leaves a gap waits in the state until the gap is filled; one already seen is dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.catalogue import Catalogue
from ..operators.filters import FilterState, Preprocessing, StreamFilter
from ..operators.peeling import Peeler, PeelState

CHUNKS = "segment int, i_start long, channels int, v array<double>"
STATE = "meta string, data binary"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _pack(meta: dict, **arrays: np.ndarray) -> tuple[str, bytes]:
    meta = meta | {"shapes": [[k, list(a.shape)] for k, a in arrays.items()]}
    return json.dumps(meta), b"".join(np.ascontiguousarray(a, float).tobytes() for a in arrays.values())


def _unpack(row) -> tuple[dict, dict[str, np.ndarray]]:
    meta, at, out = json.loads(row[0]), 0, {}
    for k, shape in meta.pop("shapes"):
        n = int(np.prod(shape)) * 8
        out[k] = np.frombuffer(bytes(row[1])[at : at + n], float).reshape(shape).copy()
        at += n
    return meta, out


class ChunkProcessor(StatefulProcessor):
    """Puts chunks in order and hands each to step(state, first sample, chunk) -> (state, output frame)."""

    output = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)
        self.waiting = handle.getMapState("waiting", "i_start long", STATE)

    def fresh(self) -> tuple[dict, dict[str, np.ndarray]]:
        raise NotImplementedError

    def step(self, meta: dict, arrays: dict[str, np.ndarray], start: int, chunk: np.ndarray) -> tuple[dict, dict[str, np.ndarray], pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        meta, arrays = _unpack(self.state.get()) if self.state.exists() else self.fresh()
        incoming = {int(s): np.asarray(v, float).reshape(-1, int(n)) for pdf in rows for s, n, v in zip(pdf["i_start"], pdf["channels"], pdf["v"], strict=True)}
        held = {int(k[0]): k for k in list(self.waiting.keys())} if self.waiting.exists() else {}
        due, out = meta["next"], []
        while due in incoming or due in held:
            if due in incoming:
                chunk = incoming.pop(due)
                if due in held:
                    self.waiting.removeKey(held.pop(due))
            else:
                chunk = _unpack(self.waiting.getValue(held[due]))[1]["chunk"]
                self.waiting.removeKey(held.pop(due))
            meta, arrays, found = self.step(meta, arrays, due, chunk)
            due += len(chunk)
            meta["next"] = due
            out.append(found.assign(segment=np.int32(key[0])))
        for start, chunk in incoming.items():
            if start > due:
                self.waiting.updateValue((start,), _pack({}, chunk=chunk))
        self.state.update(_pack(meta, **arrays))
        for found in out:
            if len(found):
                yield found

    def close(self) -> None:
        pass


class FilterProcessor(ChunkProcessor):
    """Zero-phase filtering with carried state (W03): segment, sample, v."""

    output = "segment int, sample long, v array<float>"

    def __init__(self, p: Preprocessing, pad: int, channels: int):
        self.p, self.pad, self.channels = p, pad, channels

    def fresh(self):
        s = StreamFilter(self.p, self.pad, self.channels).empty
        return {"next": 0, "position": 0}, {"state": s.state, "tail": s.tail}

    def step(self, meta, arrays, start, chunk):
        f = StreamFilter(self.p, self.pad, self.channels)
        s, first, values = f.push(FilterState(arrays["state"], arrays["tail"], meta["position"]), chunk)
        out = pd.DataFrame({"segment": np.zeros(len(values), np.int32), "sample": np.arange(first, first + len(values)), "v": list(values.astype(np.float32))})
        return meta | {"position": s.position}, {"state": s.state, "tail": s.tail}, out


class PeelProcessor(ChunkProcessor):
    """Template matching of processed chunks (R01, X02-X11): segment, index, cluster_label, jitter."""

    output = "segment int, index long, cluster_label long, jitter double"

    def __init__(self, catalogue: Catalogue, max_shift: int = 4, length: int | None = None):
        self.catalogue, self.max_shift, self.length = catalogue, max_shift, length

    def fresh(self):
        s = Peeler(self.catalogue, self.max_shift).start()
        return {"next": 0, "first": 0}, {"residual": s.residual, "held": np.zeros((0, 3))}

    def step(self, meta, arrays, start, chunk):
        held = [(int(a), int(b), float(c)) for a, b, c in arrays["held"]]
        last = self.length is not None and start + len(chunk) >= self.length
        s, ready = Peeler(self.catalogue, self.max_shift).push(PeelState(arrays["residual"], meta["first"], held), chunk, last)
        out = pd.DataFrame({"segment": np.zeros(len(ready), np.int32), "index": np.array([r[0] for r in ready], np.int64), "cluster_label": np.array([r[1] for r in ready], np.int64), "jitter": np.array([r[2] for r in ready], float)})
        return meta | {"first": s.first}, {"residual": s.residual, "held": np.array(s.held, float).reshape(-1, 3)}, out


class DetectProcessor(ChunkProcessor):
    """Peak detection with an overlap of n_span samples on both sides (E08): segment, index, channel, extremum_amplitude."""

    output = "segment int, index long, channel int, extremum_amplitude double"

    def __init__(self, catalogue: Catalogue):
        self.catalogue = catalogue

    def fresh(self):
        return {"next": 0, "first": 0}, {"tail": np.zeros((0, self.catalogue.channels))}

    def step(self, meta, arrays, start, chunk):
        x, n = np.concatenate([arrays["tail"], chunk]), self.catalogue.n_span
        found = np.argwhere(Peeler(self.catalogue).detect(x))
        keep = min(len(x), 2 * n)
        out = pd.DataFrame({"segment": np.zeros(len(found), np.int32), "index": found[:, 0] + meta["first"], "channel": found[:, 1].astype(np.int32), "extremum_amplitude": x[found[:, 0], found[:, 1]]})
        return meta | {"first": meta["first"] + len(x) - keep}, {"tail": x[len(x) - keep :]}, out


def run_chunks(chunks: DataFrame, processor: ChunkProcessor) -> DataFrame:
    """A streaming frame of a processor's output, keyed by segment. The session needs the RocksDB state store (use_rocksdb)."""
    return chunks.groupBy("segment").transformWithStateInPandas(processor, processor.output, "append", "none")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def to_chunks(frames: DataFrame, size: int) -> DataFrame:
    """Frames (segment, sample, v) gathered to chunk rows, as a recorder would send them."""
    cells = F.array_sort(F.collect_list(F.struct("sample", "v")))
    out = frames.groupBy("segment", F.floor(F.col("sample") / size).alias("_k")).agg(cells.alias("_c"))
    first = F.get("_c", 0)
    return out.select("segment", first["sample"].alias("i_start"), F.size(first["v"]).alias("channels"), F.flatten(F.transform("_c", lambda c: c["v"])).cast("array<double>").alias("v"))


def event_rates(events: DataFrame, time: str, interval: str, refresh: str, late: str, *keys: str) -> DataFrame:
    """Sliding rates with a bound on lateness."""
    from ..operators.trains import rates

    return rates(events.withWatermark(time, late), time, interval, refresh, *keys)


def waveform_histogram(spikes: DataFrame, signal: DataFrame, n_left: int, n_right: int, low: float, high: float, bins: int, late: str) -> DataFrame:
    """Running counts per label, channel, offset and amplitude bin (R06): an interval join of two streams with event times `at`.

    spikes: segment, index, cluster_label, at. signal: segment, sample, channel, value, at.
    """
    s, x = spikes.withWatermark("at", late).alias("s"), signal.withWatermark("at", late).alias("x")
    near = F.expr(f"s.segment = x.segment and x.sample >= s.index + {n_left} and x.sample < s.index + {n_right} and x.at >= s.at - interval 10 seconds and x.at <= s.at + interval 10 seconds")
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("value") - low) / ((high - low) / bins)))).cast("long")
    return s.join(x, near).select("cluster_label", "channel", (F.col("sample") - F.col("index") - n_left).alias("offset"), at.alias("bin"))


def record(frames: DataFrame, path: str, checkpoint: str):
    """A live stream written to Parquet for a later catalogue."""
    return frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("segment").outputMode("append")


class NoiseProcessor(ChunkProcessor):
    """Two phases (R05): samples are gathered until `samples` are there, then one row per channel gives median and MAD; nothing after."""

    output = "segment int, channel int, median double, mad double"

    def __init__(self, samples: int, channels: int):
        self.samples, self.channels = samples, channels

    def fresh(self):
        return {"next": 0, "done": False}, {"seen": np.zeros((0, self.channels))}

    def step(self, meta, arrays, start, chunk):
        none = pd.DataFrame({"segment": np.zeros(0, np.int32), "channel": np.zeros(0, np.int32), "median": np.zeros(0), "mad": np.zeros(0)})
        if meta["done"]:
            return meta, arrays, none
        seen = np.concatenate([arrays["seen"], chunk])
        if len(seen) < self.samples:
            return meta, {"seen": seen}, none
        seen = seen[: self.samples]
        med = np.median(seen, axis=0)
        mad = np.median(np.abs(seen - med), axis=0) * 1.4826
        out = pd.DataFrame({"segment": np.zeros(self.channels, np.int32), "channel": np.arange(self.channels, dtype=np.int32), "median": med, "mad": mad})
        return meta | {"done": True}, {"seen": seen[:0]}, out
