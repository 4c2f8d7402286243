"""Synthetic recordings with known events, in place of sample data sets."""

from __future__ import annotations

import numpy as np


def templates(channels: int = 4, width: int = 60) -> np.ndarray:
    t = np.arange(width) - width // 2
    shapes = [-np.exp(-0.5 * (t / 2.5) ** 2), -np.exp(-0.5 * (t / 4.0) ** 2) + 0.5 * np.exp(-0.5 * ((t - 9) / 3.0) ** 2), -np.exp(-0.5 * (t / 1.8) ** 2) - 0.4 * np.exp(-0.5 * ((t - 8) / 2.0) ** 2)]
    out = np.zeros((3, width, channels))
    for k, (ch, size) in enumerate(((0, 40.0), (1, 30.0), (3, 50.0))):
        for c in range(channels):
            out[k, :, c] = size * shapes[k] * 0.35 ** abs(c - ch)
    return out


def recording(n: int = 20_000, channels: int = 4, seed: int = 1, gap: int = 90, noise: float = 1.0, width: int = 60):
    """(signal, sorted list of (index, label)): templates of width 60 at known samples in Gaussian noise."""
    r = np.random.default_rng(seed)
    x = r.normal(0, noise, (n, channels))
    shapes, truth, at = templates(channels, width), [], 200
    while at < n - 200:
        k = int(r.integers(3))
        x[at - width // 2 : at + width // 2] += shapes[k]
        truth.append((at, k))
        at += gap + int(r.integers(60))
    return x, truth
