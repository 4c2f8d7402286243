"""Recursive filters: Butterworth design, zero-phase filtering of whole segments, of halo blocks and of streams.

The cascade of sections is one linear state-space system. A signal is filtered in chunks of BLOCK samples: the responses of all chunks to
their own input are one matrix product, and only the states at chunk borders are a loop.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import with_halo

BLOCK = 128
ORDER = 5


def butterworth(cutoff: float, sample_rate: float, kind: str, order: int = ORDER) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital Butterworth filter, 'high' or 'low', by the bilinear transform."""
    if not 0 < cutoff < sample_rate / 2:
        raise ValueError("the cut-off lies between 0 and half the sample rate")
    warped = 2 * np.tan(np.pi * cutoff / sample_rate)
    angles = np.pi * (2 * np.arange(order) + order + 1) / (2 * order)
    poles = warped * np.exp(1j * angles) if kind == "low" else warped / np.exp(1j * angles)
    digital = (2 + poles) / (2 - poles)
    zero = -1.0 if kind == "low" else 1.0
    sections = []
    for p in digital[digital.imag > 1e-9]:
        sections.append(([1, -2 * zero, 1], [1, -2 * p.real, abs(p) ** 2]))
    for p in digital[np.abs(digital.imag) <= 1e-9]:
        sections.append(([1, -zero, 0], [1, -p.real, 0]))
    at = -zero  # where the response is one: half the sample rate for a high-pass, zero for a low-pass
    out = []
    for b, a in sorted(sections, key=lambda s: abs(s[1][2])):
        gain = np.polyval(a, at) / np.polyval(b, at)
        out.append([*(np.array(b) * gain), *a])
    return np.array(out)


def smoother(times: int) -> np.ndarray:
    """A two-tap smoothing section, repeated."""
    b0 = np.sqrt(1 / 3)
    return np.tile([b0, 1 - b0, 0, 1, 0, 0], (times, 1))


def cascade(sample_rate: float, highpass: float | None, lowpass: float | None, smooth: int = 0) -> np.ndarray:
    """High-pass, low-pass and smoothing; cut-offs that are none, zero or beyond half the sample rate are left out."""
    parts = [butterworth(f, sample_rate, kind) for f, kind in ((highpass, "high"), (lowpass, "low")) if f and 0 < f < sample_rate / 2]
    parts += [smoother(smooth)] if smooth else []
    return np.concatenate(parts) if parts else np.array([[1.0, 0, 0, 1, 0, 0]])


@dataclass
class System:
    """A cascade as s' = A s + B x, y = C s + D x, with the tables for chunks of BLOCK samples."""

    sos: np.ndarray
    a: np.ndarray = field(init=False)
    b: np.ndarray = field(init=False)
    c: np.ndarray = field(init=False)
    d: float = field(init=False)

    def __post_init__(self):
        n = 2 * len(self.sos)
        a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
        for i, (b0, b1, b2, _, a1, a2) in enumerate(self.sos):
            u, w = c.copy(), d  # this section's input is u s + w x
            r = slice(2 * i, 2 * i + 2)
            gain = np.array([b1 - a1 * b0, b2 - a2 * b0])
            a[r] += np.outer(gain, u)
            a[r, r] += np.array([[-a1, 1], [-a2, 0]])
            b[r] = gain * w
            c, d = b0 * u, b0 * w
            c[2 * i] += 1
        self.a, self.b, self.c, self.d = a, b, c, d
        powers = [np.eye(n)]
        for _ in range(BLOCK):
            powers.append(a @ powers[-1])
        self.free = np.array([c @ p for p in powers[:BLOCK]])
        pulse = np.r_[d, self.free[:-1] @ b]
        lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
        self.own = np.where(lag >= 0, pulse[np.abs(lag)], 0)
        self.feed = np.stack([powers[BLOCK - 1 - i] @ b for i in range(BLOCK)], axis=1)
        self.step = powers[BLOCK]

    def rest(self) -> np.ndarray:
        """The state that a constant input of one settles in."""
        return np.linalg.solve(np.eye(len(self.a)) - self.a, self.b)

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Filter (sample, channel) forward; returns output and final state (n, channel)."""
        length, channels = x.shape
        state = np.zeros((len(self.a), channels)) if state is None else state.copy()
        whole = length // BLOCK * BLOCK
        out = np.empty((length, channels))
        if whole:
            blocks = x[:whole].reshape(-1, BLOCK, channels)
            fed = np.einsum("nb,kbc->knc", self.feed, blocks, optimize=True)
            states = np.empty_like(fed)
            for k in range(len(blocks)):
                states[k] = state
                state = self.step @ state + fed[k]
            out[:whole] = (np.matmul(self.own, blocks) + np.matmul(self.free, states)).reshape(whole, channels)
        for i in range(whole, length):
            out[i] = self.c @ state + self.d * x[i]
            state = self.a @ state + np.outer(self.b, x[i])
        return out, state


def zero_phase(system: System, x: np.ndarray) -> np.ndarray:
    """Forward and backward, on a signal extended oddly at both ends and started in the state of its first value."""
    sos = system.sos
    taps = 2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum()))
    pad = min(3 * taps, len(x) - 1)
    if pad < 1:
        return x.astype(float)
    ends = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]).astype(float)
    rest = system.rest()
    forth, _ = system.run(ends, np.outer(rest, ends[0]))
    back, _ = system.run(forth[::-1], np.outer(rest, forth[-1]))
    return back[::-1][pad:-pad]


@dataclass
class Preprocessing:
    """Parameters of signal preprocessing."""

    sample_rate: float
    highpass: float | None = 300.0
    lowpass: float | None = None
    smooth: int = 0
    common_reference: bool = False
    medians: list[float] | None = None
    mads: list[float] | None = None

    def system(self) -> System:
        return System(cascade(self.sample_rate, self.highpass, self.lowpass, self.smooth))

    def finish(self, x: np.ndarray) -> np.ndarray:
        if self.common_reference:
            x = x - np.median(x, axis=1, keepdims=True)
        if self.medians is not None:
            x = (x - np.asarray(self.medians)) / np.asarray(self.mads)
        return x


def preprocess(x: np.ndarray, p: Preprocessing, normalise: bool = True) -> np.ndarray:
    """One array at once: the measure for all other ways."""
    out = Preprocessing(p.sample_rate, p.highpass, p.lowpass, p.smooth, p.common_reference).finish(zero_phase(p.system(), x))
    if normalise:
        med = np.median(out, axis=0)
        mad = np.median(np.abs(out - med), axis=0) * 1.4826
        out = (out - med) / mad
    return out


def preprocess_blocks(frames: DataFrame, p: Preprocessing, block: int, pad: int) -> DataFrame:
    """Frames (segment, sample, v) filtered block by block with a halo on both sides.

    Blocks are independent: the work spreads over segments and time alike. Each frame is sent to the one to three blocks that need it.
    """
    spread = with_halo(frames.select("segment", "sample", "v"), "sample", block, pad)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        out = p.finish(zero_phase(p.system(), x))
        core = pdf["core"].to_numpy()
        return pd.DataFrame({"segment": pdf["segment"][core], "sample": pdf["sample"][core], "v": pd.Series(list(out[core].astype(np.float32)), pdf.index[core], object)})

    return spread.groupBy("segment", "block").applyInPandas(run, "segment int, sample long, v array<float>")


@dataclass
class FilterState:
    """What a streaming zero-phase filter carries from chunk to chunk."""

    state: np.ndarray
    tail: np.ndarray
    position: int


class StreamFilter:
    """Zero-phase filtering of consecutive chunks: forward with carried state, backward over the last chunk and a look-ahead of `pad` samples; output lags by pad."""

    def __init__(self, p: Preprocessing, pad: int, channels: int):
        self.p, self.pad, self.system = p, pad, p.system()
        self.empty = FilterState(np.zeros((len(self.system.a), channels)), np.zeros((0, channels)), 0)

    def push(self, s: FilterState, chunk: np.ndarray) -> tuple[FilterState, int, np.ndarray]:
        """New state, first sample and values of the output that the chunk completes."""
        forth, state = self.system.run(chunk, s.state)
        held = np.concatenate([s.tail, forth])
        position = s.position + len(chunk)
        ready = len(held) - self.pad
        if ready <= 0:
            return FilterState(state, held, position), position - len(held), np.zeros((0, chunk.shape[1]))
        back, _ = self.system.run(held[::-1])
        return FilterState(state, held[ready:], position), position - len(held), self.p.finish(back[::-1][:ready])


def array_stats(frames: DataFrame, sample: str = "sample", length: int | None = None) -> DataFrame:
    """Median and MAD per channel of frames (W08), exactly, in long form."""
    from ..functions.robust import median_mad

    head = frames if length is None else frames.filter(F.col(sample) < length)
    return median_mad(head.select(F.posexplode("v").alias("channel", "value")), ["channel"], "value")
