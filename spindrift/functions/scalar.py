"""Scalar column expressions: units, packed colours, windows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ms_to_samples(ms: Column | float, sample_rate: float) -> Column:
    """Milliseconds to samples, truncated toward zero."""
    ms = ms if isinstance(ms, Column) else F.lit(float(ms))
    return (ms / F.lit(1000.0) * F.lit(float(sample_rate))).cast("long")


def samples_to_seconds(sample: Column, sample_rate: float) -> Column:
    return sample / F.lit(float(sample_rate))


def mad_to_microvolt(amplitude: Column, mad: Column, bit_to_microvolt: float) -> Column:
    return amplitude * mad * F.lit(float(bit_to_microvolt))


def half_window(sample_rate: float, span_ms: float) -> int:
    """Half the width, in samples and at least one, of a span in ms."""
    return max(1, int(sample_rate * span_ms / 1000) // 2)


def halo_width(sample_rate: float, highpass_freq: float) -> int:
    """Samples that a block needs on either side for a high-pass to settle."""
    if not highpass_freq:
        raise ValueError("a halo width follows from a high-pass frequency")
    return int(sample_rate / highpass_freq * 3)


def pack_rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Four bytes as one long, red highest."""
    return sum((F.shiftleft(c.cast("long"), s) for c, s in ((r, 24), (g, 16), (b, 8))), a.cast("long"))


def unpack_rgba(packed: Column) -> Column:
    parts = {n: F.shiftrightunsigned(packed.cast("long"), s).bitwiseAND(255) for n, s in (("r", 24), ("g", 16), ("b", 8), ("a", 0))}
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def spike_time(index: Column, jitter: Column, sample_rate: float) -> Column:
    """Time in seconds of a spike; an unknown (NaN) jitter counts as none."""
    return (index + F.nanvl(jitter, F.lit(0.0))) / F.lit(float(sample_rate))


def inside_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon: an odd number of its edges crosses the ray to the right."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y0 != y1:
            at = F.lit(x0) + (y - F.lit(y0)) * F.lit((x1 - x0) / (y1 - y0))
            crossings = crossings + (((y > F.lit(y0)) != (y > F.lit(y1))) & (x < at)).cast("int")
    return crossings % 2 == 1


def hue_colour(rank: Column, total: Column, saturation: float = 0.65, light: float = 0.6) -> Column:
    """A packed opaque colour for item `rank` of `total`, hues evenly spaced."""
    hue = 6.0 * rank / F.greatest(total, F.lit(1))
    reach = saturation * min(light, 1 - light)

    def channel(shift: int) -> Column:
        k = F.pmod(F.lit(float(shift)) + hue * 2, F.lit(12.0))
        value = F.lit(light) - F.lit(reach) * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.round(value * 255).cast("long")

    return pack_rgba(channel(0), channel(8), channel(4), F.lit(255))


def random_projection(size: int, seed: int) -> list[float]:
    """A unit vector in a direction that depends on the seed alone."""
    import numpy as np

    v = np.random.default_rng(seed).normal(size=size)
    return (v / math.sqrt(float(v @ v))).tolist()


def tour(start: list[float], end: list[float], steps: int) -> list[list[float]]:
    """Unit vectors on the way between two directions, both ends included."""
    import numpy as np

    a, b = np.asarray(start, float), np.asarray(end, float)
    out = []
    for w in np.linspace(0, 1, max(2, steps)):
        v = (1 - w) * a + w * b
        size = math.sqrt(float(v @ v))
        out.append((v / size if size else a).tolist())
    return out
