"""Feature extraction: uncentred singular vectors, per channel or over all channels, and linear discriminants.

Only Gram matrices (features by features, a size that the waveform window fixes) are brought together; waveforms stay where they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import project


def gram(waves: DataFrame, wave: str, keys: list[str] | None = None) -> dict[tuple, tuple[int, np.ndarray]]:
    """Number of rows and X'X for each key (one entry, (), without keys); partial sums in each task, summed pairwise by key."""
    keys = keys or []
    cols = waves.select(*keys, F.col(wave).cast("array<double>").alias("_w"))

    def partial(batches):
        sums: dict[tuple, list] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys) if keys else [((), pdf)]:
                x = np.stack(part["_w"].to_numpy())
                key = key if isinstance(key, tuple) else (key,)
                n, g = sums.get(key, (0, 0))
                sums[key] = [n + len(x), g + x.T @ x]
        for key, (n, g) in sums.items():
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "n": [n], "g": [g.ravel()]})

    schema = ", ".join([*(f"`{k}` {dict(cols.dtypes)[k]}" for k in keys), "n long", "g array<double>"])
    parts = cols.mapInPandas(partial, schema).select(*keys, "n", F.posexplode("g").alias("i", "x"))
    summed = parts.groupBy(*keys, "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out: dict[tuple, dict] = {}
    for r in summed.collect():  # the square of a waveform's size, for each key
        out.setdefault(tuple(r[k] for k in keys), {})[r["i"]] = (r["n"], r["x"])
    found = {}
    for key, cells in out.items():
        size = int(round(np.sqrt(len(cells))))
        found[key] = (cells[0][0], np.array([cells[i][1] for i in range(len(cells))]).reshape(size, size))
    return found


def singular_vectors(g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading singular values and right vectors from X'X; the largest entry of each vector is positive."""
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(values)[::-1][:n]
    v = vectors[:, order].T
    v *= np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    return np.sqrt(np.maximum(values[order], 0)), v


def global_svd(waves: DataFrame, id_col: str, wave: str, n_components: int = 5, fit_on: DataFrame | None = None) -> tuple[DataFrame, np.ndarray]:
    """Projections on the leading uncentred singular vectors of flattened waveforms (F05): (id, features), components."""
    g = gram(waves if fit_on is None else fit_on, wave)
    if not g:
        return waves.select(id_col, F.array().cast("array<double>").alias("features")), np.zeros((0, 0))
    _, v = singular_vectors(g[()][1], n_components)
    return transform(waves, id_col, wave, v), v


def transform(waves: DataFrame, id_col: str, wave: str, components: np.ndarray) -> DataFrame:
    x = F.col(wave).cast("array<double>")
    return waves.select(id_col, F.array(*[project(x, c.tolist()) for c in components]).alias("features"))


def svd_by_channel(waves: DataFrame, id_col: str, wave: str, channels: int, peak_channel: str, adjacency: DataFrame | None = None, n_components: int = 3) -> DataFrame:
    """(id, channel, component, value): one decomposition per channel, fitted on the peaks of that channel.

    With adjacency (c1, c2), only waveforms whose peak channel is adjacent to a channel are projected on it; others have no row, which stands
    for zero. Channels with too few peaks (n - 1 <= n_components) have no features.
    """
    width = F.size(wave) / channels
    each = F.sequence(F.lit(0), F.lit(channels - 1))
    own = waves.select(id_col, F.col(peak_channel).alias("_pc"), F.explode(F.transform(each, lambda c: F.struct(c.alias("channel"), F.transform(F.sequence(F.lit(0), (width - 1).cast("int")), lambda i: F.get(F.col(wave), (i * channels + c).cast("int")).cast("double")).alias("x")))).alias("_s"))
    own = own.select(id_col, "_pc", "_s.*")
    grams = gram(own.filter("_pc = channel"), "x", ["channel"])
    fitted = {k[0]: singular_vectors(g, n_components)[1] for k, (n, g) in grams.items() if n - 1 > n_components}
    if adjacency is not None:
        own = own.join(F.broadcast(adjacency.select(F.col("c1").alias("_pc"), F.col("c2").alias("channel"))), ["_pc", "channel"], "left_semi")
    out = None
    for channel, v in sorted(fitted.items()):
        part = own.filter(F.col("channel") == channel).select(id_col, "channel", F.posexplode(F.array(*[project(F.col("x"), c.tolist()) for c in v])).alias("component", "value"))
        out = part if out is None else out.unionByName(part)
    return own.select(id_col, "channel", F.lit(0).alias("component"), F.lit(0.0).alias("value")).limit(0) if out is None else out


def discriminants(waves: DataFrame, wave: str, label: str, n_components: int | None = None, ridge: float = 1e-6) -> np.ndarray:
    """Linear discriminant directions of labelled waveforms (F08), from per-label Gram matrices and means."""
    sums = gram(waves.withColumn("_one", F.concat(F.col(wave).cast("array<double>"), F.array(F.lit(1.0)))), "_one", [label])
    total = sum(g for _, g in sums.values())
    n = total[-1, -1]
    mean = total[-1, :-1] / n
    within = sum(g[:-1, :-1] - np.outer(g[-1, :-1], g[-1, :-1]) / g[-1, -1] for _, g in sums.values())
    between = sum(g[-1, -1] * np.outer(g[-1, :-1] / g[-1, -1] - mean, g[-1, :-1] / g[-1, -1] - mean) for _, g in sums.values())
    within += ridge * np.trace(within) / len(within) * np.eye(len(within))
    root = np.linalg.inv(np.linalg.cholesky(within))
    values, vectors = np.linalg.eigh(root @ between @ root.T)
    order = np.argsort(values)[::-1][: n_components or len(sums) - 1]
    v = (root.T @ vectors[:, order]).T
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def extract(waves: DataFrame, id_col: str, wave: str, method: str, **options):
    """Features by method name."""
    if method == "global_pca":
        return global_svd(waves, id_col, wave, **options)[0]
    if method == "pca_by_channel":
        return svd_by_channel(waves, id_col, wave, **options)
    if method == "peak_max":
        from .waveforms import value_at

        return value_at(waves, id_col, wave, **options)
    if method == "global_lda":
        return transform(waves, id_col, wave, discriminants(waves, wave, **options))
    raise ValueError(f"unknown feature method {method}")
