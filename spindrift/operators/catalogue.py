"""Template catalogues: centroids, discriminating projections and all that matching needs, as one table row."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "chan_grp int, name string, arrays map<string,binary>, meta string"


@dataclass
class Catalogue:
    """Small arrays: one template per cluster. boundaries: strict low and high, flexible low and high."""

    labels: list[int]
    centers: np.ndarray  # (cluster, width, channel)
    centers_long: np.ndarray
    projections: np.ndarray
    boundaries: np.ndarray
    masks: list[np.ndarray]  # sparse masks (cluster, channel) of levels 1 to 3
    extremum_channel: list[int]
    n_left: int
    n_left_long: int
    sample_rate: float
    threshold: float
    n_span: int
    sign: str = "-"
    alien: float | None = None
    neighbours: list[list[int]] = field(default_factory=list)
    chan_grp: int = 0
    preprocessing: dict = field(default_factory=dict)

    @property
    def channels(self) -> int:
        return self.centers_long.shape[2]

    @property
    def width_long(self) -> int:
        return self.centers_long.shape[1]


ARRAYS = ("centers", "centers_long", "projections", "boundaries")


def projections(centers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """One vector per template: (w - center) . vector is 0 on the template and at least 1 in magnitude on each rival.

    Rivals are the other templates that share a channel, and noise (zero). The direction leads from the template to the nearest
    point of the plane through its nearest rivals; rivals are added until all of them lie beyond 1.
    """
    n = len(centers)
    flat = (centers * mask[:, None, :]).reshape(n, -1)
    out = np.zeros_like(flat)
    if n == 1:
        return out.reshape(centers.shape)
    for i in range(n):
        on = np.repeat(mask[i][None], centers.shape[1], 0).ravel()
        own = centers[i].ravel() * on
        rivals = [centers[j].ravel() * on for j in range(n) if j != i and (mask[i] & mask[j]).any()] + [np.zeros_like(own)]
        gaps = np.array(sorted((r - own for r in rivals), key=lambda g: float(g @ g)))
        gaps = gaps[(gaps * gaps).sum(1) > 0]
        for k in range(1, len(gaps) + 1):
            near = gaps[:k]
            base = near[0]
            if k > 1:
                span = near[1:] - base
                _, s, v = np.linalg.svd(span, full_matrices=False)
                v = v[s > 1e-9 * max(s[0], 1e-30)]
                base = base - v.T @ (v @ base)
            size = float(base @ base)
            if size < 1e-12:
                base = near[0]
                size = float(base @ base)
            out[i] = base / size
            if (np.abs(gaps @ out[i]) >= 1 - 1e-9).all():
                break
    return out.reshape(centers.shape)


def tuned_boundaries(inner: np.ndarray, other: np.ndarray, steps: int = 20) -> tuple[float, float]:
    """Bounds around the inner products of a template's own waveforms that separate them best from others' (T04), within +-0.5."""
    med = float(np.median(inner))
    mad = float(np.median(np.abs(inner - med))) * 1.4826

    def quality(low: float, high: float) -> float:
        tp = ((inner >= low) & (inner <= high)).sum()
        fp = ((other >= low) & (other <= high)).sum()
        return tp / max(1, len(inner) + fp)

    low, high = max(-0.5, med - 6 * mad), min(0.5, med + 6 * mad)
    lows, highs = np.linspace(low, min(med, 0.0), steps), np.linspace(max(med, 0.0), high, steps)
    best = max(lows, key=lambda b: (quality(b, high), -b))
    return float(best), float(max(highs, key=lambda b: (quality(best, b), b)))


def sparse(centers: np.ndarray, threshold: float) -> np.ndarray:
    """Channels where a template exceeds a threshold; its extremum channel always."""
    top = np.abs(centers).max(1)
    mask = top > threshold
    mask[np.arange(len(mask)), top.argmax(1)] = True
    return mask


def make_catalogue(labels: list[int], centers_long: np.ndarray, n_left: int, n_right: int, n_left_long: int, sample_rate: float, threshold: float, n_span: int, sign: str = "-", alien: float | None = None, neighbours: list[list[int]] | None = None, levels: tuple[float, float] = (1.0, 3.0), boundaries: np.ndarray | None = None, **more) -> Catalogue:
    """A catalogue from long centroids (T05). Boundaries default to +-0.5, strict and flexible."""
    at = n_left - n_left_long
    centers = centers_long[:, at : at + n_right - n_left]
    masks = [sparse(centers, t) for t in (levels[0], levels[1], threshold)]
    peak = centers[:, -n_left]
    extremum = (peak.argmin(1) if sign == "-" else peak.argmax(1)).tolist() if len(centers) else []
    bounds = np.tile([-0.5, 0.5, -0.5, 0.5], (len(labels), 1)) if boundaries is None else boundaries
    near = neighbours or [[c] for c in range(centers_long.shape[2])]
    return Catalogue(list(labels), centers, centers_long, projections(centers, masks[0]) if len(labels) else centers, bounds, masks, extremum, n_left, n_left_long, sample_rate, threshold, n_span, sign, alien, near, **more)


def empty_catalogue(channels: int, n_left: int = -15, n_right: int = 20, sample_rate: float = 20000.0, threshold: float = 5.0, n_span: int = 4, **more) -> Catalogue:
    """A catalogue without templates: matching then only detects."""
    return make_catalogue([], np.zeros((0, 2 * (n_right - n_left), channels)), n_left, n_right, 2 * n_left, sample_rate, threshold, n_span, **more)


def to_row(spark: SparkSession, c: Catalogue, name: str = "initial") -> DataFrame:
    """One row with arrays as bytes and the rest as JSON (S14); nothing is pickled."""
    arrays = {k: np.asarray(getattr(c, k), float) for k in ARRAYS} | {f"mask{i}": np.asarray(m, float) for i, m in enumerate(c.masks, 1)}
    meta = {k: v for k, v in asdict(c).items() if k not in (*ARRAYS, "masks")} | {"shapes": {k: list(v.shape) for k, v in arrays.items()}}
    return spark.createDataFrame([(c.chan_grp, name, {k: bytearray(np.ascontiguousarray(v).tobytes()) for k, v in arrays.items()}, json.dumps(meta))], SCHEMA)


def from_row(row) -> Catalogue:
    meta = json.loads(row["meta"])
    shapes = meta.pop("shapes")
    arrays = {k: np.frombuffer(bytes(v), float).reshape(shapes[k]) for k, v in row["arrays"].items()}
    masks = [arrays.pop(f"mask{i}") > 0 for i in (1, 2, 3)]
    return Catalogue(**meta, **arrays, masks=masks)


def save_catalogue(spark: SparkSession, c: Catalogue, path: str, name: str = "initial") -> None:
    to_row(spark, c, name).coalesce(1).write.mode("overwrite").parquet(f"{path}/chan_grp={c.chan_grp}/name={name}/")


def load_catalogue(spark: SparkSession, path: str, chan_grp: int = 0, name: str = "initial") -> Catalogue:
    return from_row(spark.read.parquet(f"{path}/chan_grp={chan_grp}/name={name}/").first())


def from_centroids(centres: DataFrame, label: str, channels: int, **options) -> Catalogue:
    """From long-form centroids (label, offset, channel, median): cluster-size data."""
    rows = centres.select(label, "offset", "channel", "median").collect()
    labels = sorted({r[0] for r in rows if r[0] >= 0})
    width = 1 + max((r[1] for r in rows), default=-1)
    array = np.zeros((len(labels), width, channels))
    where = {k: i for i, k in enumerate(labels)}
    for k, offset, channel, value in rows:
        if k in where:
            array[where[k], offset, channel] = value
    return make_catalogue(labels, array, **options)
