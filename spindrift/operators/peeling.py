"""Template matching: events are classified against a catalogue, largest first, and subtracted, until nothing more is accepted.

The kernel is a pure function (state, chunk) -> (state, spikes), the same in batch (a segment at a time) and in streams.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import Catalogue

UNCLASSIFIED, ALIEN, LEFT, RIGHT, MAX_SHIFT = -10, -9, -11, -12, -13


@dataclass
class PeelState:
    """The residual still open, the sample of its first row, and accepted spikes held back for the next chunk."""

    residual: np.ndarray
    first: int
    held: list[tuple[int, int, float]]


class Peeler:
    def __init__(self, catalogue: Catalogue, max_shift: int = 4, keep_bad: bool = False):
        self.c, self.max_shift, self.keep_bad = catalogue, max_shift, keep_bad
        self.margin = catalogue.width_long + 2 * max_shift + 2 * catalogue.n_span + 1
        self.near = np.zeros((catalogue.channels, catalogue.channels), bool)
        for a, others in enumerate(catalogue.neighbours):
            self.near[a, others] = True
        self.near |= np.eye(catalogue.channels, dtype=bool)

    def start(self) -> PeelState:
        return PeelState(np.zeros((0, self.c.channels)), 0, [])

    def detect(self, x: np.ndarray) -> np.ndarray:
        """Mask of spatio-temporal extremes beyond the threshold."""
        c, n = self.c, self.c.n_span
        v = x if c.sign == "+" else -x
        mask = np.zeros(v.shape, bool)
        if len(v) < 2 * n + 1:
            return mask
        core = v[n : len(v) - n]
        top = core > c.threshold
        at = np.flatnonzero(top.any(1))
        for i in at.tolist():
            for ch in np.flatnonzero(top[i]).tolist():
                around = v[i : i + 2 * n + 1, self.near[ch]]
                own = core[i, ch]
                if own >= around[n].max() and (n == 0 or (own > around[:n].max() and own >= around[n + 1 :].max())):
                    mask[i + n, ch] = True
        return mask

    def classify(self, x: np.ndarray, index: int, channel: int) -> tuple[int, int, int]:
        """Label (or why there is none), template number and aligned index."""
        c = self.c
        left, left_long = index + c.n_left, index + c.n_left_long
        if min(left, left_long) - self.max_shift < 0:
            return LEFT, -1, index
        if left_long + c.width_long + self.max_shift >= len(x):
            return RIGHT, -1, index
        if not c.labels:
            return UNCLASSIFIED, -1, index
        width = c.centers.shape[1]
        wave = x[left : left + width]
        if c.alien is not None and c.alien > 0 and (np.abs(wave) > c.alien).any():
            return ALIEN, -1, index
        score = np.full(len(c.labels), 10.0)
        covers = c.masks[0][:, channel]
        for k in np.flatnonzero(covers):
            on = c.masks[0][k]
            score[k] = ((wave - c.centers[k]) * c.projections[k])[:, on].sum()
        b = c.boundaries
        inside = (score > b[:, 0]) & (score < b[:, 1])
        if not inside.any():
            inside = (score > b[:, 2]) & (score < b[:, 3])
        candidates = np.flatnonzero(inside & covers)
        if len(candidates) == 0:
            return UNCLASSIFIED, -1, index
        on = c.masks[2][candidates].any(0)
        shifts = range(-self.max_shift, self.max_shift + 1)
        cost = {(int(k), s): float(((x[left + s : left + s + width] - c.centers[k])[:, on] ** 2).sum()) for k in candidates for s in shifts}
        k, s = min(cost, key=lambda e: (cost[e], abs(e[1])))
        if self.max_shift and abs(s) == self.max_shift:
            return MAX_SHIFT, -1, index
        own = c.masks[0][k]
        fit = ((x[left + s : left + s + width] - c.centers[k]) * c.projections[k])[:, own].sum()
        return (c.labels[k], k, index + s) if b[k, 2] < fit < b[k, 3] else (UNCLASSIFIED, -1, index)

    def peel(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
        """Residual, accepted (index, label) and remaining peaks of an array, by passes until one accepts nothing."""
        c, x = self.c, x.copy()
        tested = np.zeros(x.shape, bool)
        accepted: list[tuple[int, int]] = []
        while True:
            peaks = np.argwhere(self.detect(x) & ~tested)
            order = sorted(peaks.tolist(), key=lambda p: (-abs(x[p[0], p[1]]), p[0], p[1]))
            closed: list[tuple[int, int, np.ndarray]] = []
            gained: list[tuple[int, int]] = []
            for i, ch in order:
                if any(lo < i < hi and on[ch] for lo, hi, on in closed):
                    continue
                tested[i, ch] = True
                label, k, at = self.classify(x, i, ch)
                if k < 0:
                    continue
                start = at + c.n_left_long
                x[start : start + c.width_long] -= c.centers_long[k]
                accepted.append((at, label))
                gained.append((at, k))
                closed.append((at + c.n_left, at + c.n_left + c.centers.shape[1], c.masks[0][k]))
            if not gained:
                left = [(int(i), UNCLASSIFIED) for i, _ in np.argwhere(self.detect(x))]
                return x, accepted, left
            for at, k in gained:
                lo = max(0, at + c.n_left_long)
                tested[lo : at + c.n_left_long + c.width_long, c.masks[0][k]] = False

    def push(self, s: PeelState, chunk: np.ndarray, last: bool = False) -> tuple[PeelState, list[tuple[int, int, float]]]:
        """Take in the next chunk; spikes near its end wait for the samples behind them, unless it is the last."""
        x = np.concatenate([s.residual, chunk])
        residual, found, bad = self.peel(x)
        if self.keep_bad:
            found = found + bad
        out = [*s.held, *((s.first + i, label, float("nan")) for i, label in found)]
        if last:
            return PeelState(residual[:0], s.first + len(x), []), sorted(out)
        keep = min(len(x), 2 * self.margin)
        border = s.first + len(x) - self.margin
        ready = sorted(o for o in out if o[0] < border)
        wait = [o for o in out if o[0] >= border]
        if self.keep_bad:  # what is not accepted yet is judged again
            wait = [o for o in wait if o[1] != UNCLASSIFIED]
        return PeelState(residual[len(x) - keep :], s.first + len(x) - keep, wait), ready


SPIKES = "segment int, index long, cluster_label long, jitter double"


def peel_segments(frames: DataFrame, catalogue: Catalogue, chunk: int | None = None, max_shift: int = 4, keep_bad: bool = False) -> DataFrame:
    """Spikes of processed frames (segment, sample, v): whole segments, in parallel over segments.

    With chunk, a segment passes through the kernel chunk by chunk as a stream would, in memory of a few chunks.
    """
    peeler = Peeler(catalogue, max_shift, keep_bad)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        if (np.diff(pdf["sample"].to_numpy()) != 1).any():
            raise ValueError("a segment has a gap")
        first = int(pdf["sample"].iloc[0])
        state, out = PeelState(np.zeros((0, catalogue.channels)), first, []), []
        size = chunk or len(x)
        for a in range(0, len(x), size):
            state, ready = peeler.push(state, x[a : a + size], last=a + size >= len(x))
            out += ready
        return pd.DataFrame({"segment": np.full(len(out), pdf["segment"].iloc[0], np.int32), "index": np.array([o[0] for o in out], np.int64), "cluster_label": np.array([o[1] for o in out], np.int64), "jitter": np.array([o[2] for o in out], float)})

    return frames.select("segment", "sample", "v").groupBy("segment").applyInPandas(run, SPIKES)


def peel_blocks(frames: DataFrame, catalogue: Catalogue, block: int, halo: int | None = None, max_shift: int = 4) -> DataFrame:
    """The same in parallel over blocks of long segments: each block is peeled with a halo and keeps the spikes of its own samples.

    Equal to whole segments where events further apart than the halo do not influence each other.
    """
    from .relational import with_halo

    peeler = Peeler(catalogue, max_shift)
    spread = with_halo(frames.select("segment", "sample", "v"), "sample", block, halo or 4 * peeler.margin)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        x, first = np.stack(pdf["v"].to_numpy()).astype(float), int(pdf["sample"].iloc[0])
        own = int(pdf["block"].iloc[0])
        _, found, _ = peeler.peel(x)
        out = sorted((first + i, label) for i, label in found if (first + i) // block == own)
        return pd.DataFrame({"segment": np.full(len(out), pdf["segment"].iloc[0], np.int32), "index": np.array([o[0] for o in out], np.int64), "cluster_label": np.array([o[1] for o in out], np.int64), "jitter": np.full(len(out), np.nan)})

    return spread.groupBy("segment", "block").applyInPandas(run, SPIKES)


def templates_long(spark, c: Catalogue) -> DataFrame:
    """Templates for reconstruction: label, offset from the spike, channel, value."""
    rows = [(int(k), int(o + c.n_left_long), int(ch), float(c.centers_long[i, o, ch])) for i, k in enumerate(c.labels) for o in range(c.width_long) for ch in range(c.channels)]
    return spark.createDataFrame(rows, "cluster_label long, offset int, channel int, value double")


def score_peaks(waves: DataFrame, catalogue: Catalogue, id_col: str, wave: str) -> DataFrame:
    """(id, label, score): inner products of waveforms with all templates' projections (X06), as expressions over a broadcast catalogue."""
    from ..functions.arrays import dot

    spark = waves.sparkSession
    rows = []
    for i, k in enumerate(catalogue.labels):
        on = np.repeat(catalogue.masks[0][i][None], catalogue.centers.shape[1], 0).ravel()
        p = catalogue.projections[i].ravel() * on
        rows.append((int(k), p.tolist(), float(catalogue.centers[i].ravel() @ p)))
    table = spark.createDataFrame(rows, "label long, p array<double>, at double")
    return waves.select(id_col, wave).crossJoin(F.broadcast(table)).select(id_col, "label", (dot(F.col(wave).cast("array<double>"), F.col("p")) - F.col("at")).alias("score"))
