"""Saw-chain cut of whole tables (K12): bumps of the amplitude density of one channel after the other are cut off, then close classes are merged.

The driver sees histograms alone, of channels times bins; a class is a chain of conditions on amplitudes, so a cut moves no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import forest, saved
from .relational import sample_per_key
from .waveforms import long_form

STEP = 0.1
CHAIN = 24


def bumps(density: np.ndarray, rows: float, nb_min: int, contrast: float) -> list[tuple[int, int, int]]:
    """(left valley, top, right valley) of the bumps of a density on a grid of STEP that stand out.

    A valley is kept if the lower of the tops at its sides rises above it by the share `contrast` of its density: ripples fall together into one bump. Bumps
    of fewer than nb_min of the rows are joined over the higher of their valleys.
    """
    up = np.diff(density) > 0
    tops = (np.flatnonzero(up[:-1] & ~up[1:]) + 1).tolist()
    if not tops:
        return []
    valleys = [0, *[a + int(density[a : b + 1].argmin()) for a, b in zip(tops, tops[1:], strict=False)], len(density) - 1]

    def without(i: int, top: int) -> None:
        del valleys[i], tops[top]

    while True:
        shallow = next((i for i in range(1, len(valleys) - 1) if min(density[tops[i - 1]], density[tops[i]]) < (1 + contrast) * density[valleys[i]]), None)
        if shallow is None:
            break
        without(shallow, shallow - 1 if density[tops[shallow - 1]] < density[tops[shallow]] else shallow)
    while len(tops) > 1:
        sizes = [density[a:b].sum() * STEP * rows for a, b in zip(valleys, valleys[1:], strict=False)]
        small = next((i for i, n in enumerate(sizes) if n < nb_min), None)
        if small is None:
            break
        inner = [i for i in (small, small + 1) if 0 < i < len(valleys) - 1]
        without(max(inner, key=lambda i: density[valleys[i]]), small)
    sizes = [density[a:b].sum() * STEP * rows for a, b in zip(valleys, valleys[1:], strict=False)]
    return [b for b, n in zip(zip(valleys, tops, valleys[1:], strict=False), sizes, strict=True) if n >= nb_min]


def last_bump(counts: np.ndarray, start: float, threshold: float, nb_min: int, bandwidth: float, contrast: float, margin: float = 1.0) -> tuple[float, float] | None:
    """The limits of the bump of largest amplitudes in a histogram with bins of STEP from start on; none if the density has no bump apart from what
    rises at the threshold."""
    centres = start + STEP * (np.arange(len(counts)) + 0.5)
    grid = np.arange(threshold, centres[-1] + STEP, STEP)
    rows = counts.sum()
    if not rows or len(grid) < 3:
        return None
    density = np.exp(-0.5 * ((grid[:, None] - centres[None]) / bandwidth) ** 2) @ counts / (rows * bandwidth * np.sqrt(2 * np.pi))
    found = bumps(density, rows, nb_min, contrast)
    if found and (density[found[0][1]] < (1 + contrast) * density[found[0][0]] or grid[found[0][1]] < threshold + margin):
        found = found[1:]
    return (float(grid[found[-1][0]]), float(grid[found[-1][2]]) + (STEP if found[-1][2] == len(grid) - 1 else 0.0)) if found else None


def _percentile(counts: np.ndarray, share: float) -> float:
    """Of a histogram, in bins."""
    at = share * counts.sum()
    sums = np.cumsum(counts)
    i = int(np.searchsorted(sums, at))
    return i + (at - (sums[i] - counts[i])) / max(counts[i], 1)


def saw_chain_table(peaks: DataFrame, id_col: str, amplitudes: str, threshold: float, nb_min: int = 20, bandwidth: float = 1.0, contrast: float = 0.3, max_loop: int = 1000, nb_remain: int = 30) -> DataFrame:
    """(id, cluster_label) for any number of rows; -1 is what no bump holds. amplitudes: one number per channel, positive outward.

    The working class is cut on the channel of largest 90th percentile (of amplitudes above the threshold, more than nb_min of them) to the bump of largest amplitudes; the rest waits as
    a class of its own. A class that no channel cuts any further, and one at least has cut, is done. Percentiles and densities come from histograms
    with bins of a tenth. Null amplitudes count as far below the threshold; an empty table gives an empty result.
    """
    low = threshold - 1.0
    rows = peaks.select(F.col(id_col).alias("_id"), F.transform(F.coalesce(F.col(amplitudes).cast("array<double>"), F.array().cast("array<double>")), lambda v: F.coalesce(v, F.lit(-1e300))).alias("_a"), F.lit(0).alias("_class"))
    rows = saved(rows, "amplitudes")

    def histograms(inside: Column) -> tuple[int, dict[int, np.ndarray]]:
        """Rows of a class and, of each channel, the counts of its amplitudes above low."""
        own = rows.filter(inside)
        bins = own.select(F.posexplode("_a").alias("_c", "_v")).filter(F.col("_v") > low).groupBy("_c", F.floor((F.col("_v") - low) / STEP).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        found: dict[int, dict[int, int]] = {}
        for r in bins.collect():  # channels times bins
            found.setdefault(r["_c"], {})[r["_b"]] = r["_n"]
        out = {}
        for c, h in found.items():
            out[c] = np.zeros(max(h) + 1)
            out[c][list(h)] = list(h.values())
        return own.count(), out

    skip = round(1.0 / STEP)  # bins below the threshold

    def cut(inside: Column, n: int, counts: dict[int, np.ndarray]) -> tuple[Column | None, bool]:
        """The condition of a bump that holds some of a class, and whether a bump of any channel holds all of it."""
        alone = False
        for _, c in sorted((-_percentile(h[skip:], 0.9), c) for c, h in counts.items() if h[skip:].sum() > nb_min):
            limits = last_bump(counts[c], low, threshold, nb_min, bandwidth, contrast)
            if limits:
                x = F.coalesce(F.try_element_at("_a", F.lit(c + 1)), F.lit(-1e300))
                within = (x > limits[0]) & (x < limits[1])
                held = rows.filter(inside & within).count()
                if nb_min <= held < n:
                    return within, alone
                alone |= held == n
        return None, alone

    left = rows.count()
    waiting: list[tuple[Column, bool]] = [(F.col("_class") == 0, False)]
    done: list[Column] = []
    chain = 0
    for turn in range(max_loop):
        if not waiting or turn and left < nb_remain:
            break
        inside, was_cut = waiting.pop()
        n, counts = histograms(inside)
        within, alone = cut(inside, n, counts) if n >= nb_min else (None, False)
        if within is not None:
            waiting += [(inside & ~within, False), (inside & within, True)]
            chain += 1
        else:
            left -= n
            if n >= nb_min and (was_cut or alone):
                done.append(inside)
        if chain >= CHAIN:
            # long chains of conditions become numbers
            known = [*done, *[w for w, _ in waiting]]
            rows = saved(rows.withColumn("_class", _numbers(known)), "classes")
            done = [F.col("_class") == i for i in range(len(done))]
            waiting = [(F.col("_class") == len(done) + i, inner) for i, (_, inner) in enumerate(waiting)]
            chain = 0
    return rows.select(F.col("_id").alias(id_col), _numbers(done).cast("long").alias("cluster_label"))


def _numbers(classes: list[Column]) -> Column:
    out = F.lit(-1)
    for i, inside in reversed(list(enumerate(classes))):
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def merge_close(labels: DataFrame, waves: DataFrame, id_col: str, wave: str, channels: int, limit: float = 2.0, n_wave: int = 300) -> DataFrame:
    """labels (id, cluster_label) where classes whose centroids differ by less than limit at every sample and channel are one, again and again
    until no two are that close. Centroids are medians of at most n_wave waveforms of a class and come to the driver, as many as classes."""
    while True:
        own = saved(labels, "labels")
        valid = waves.select(id_col, wave).join(own.filter("cluster_label >= 0"), id_col)
        long = long_form(sample_per_key(valid, ["cluster_label"], id_col, n_wave), id_col, wave, channels, "cluster_label")
        medians = long.groupBy("cluster_label", "offset", "channel").agg(F.median("value").alias("_m"))
        shapes: dict[int, dict] = {}
        for r in medians.collect():  # a catalogue's centroids
            shapes.setdefault(r["cluster_label"], {})[r["offset"], r["channel"]] = r["_m"]
        names = sorted(shapes)
        arrays = [np.array([shapes[k][x] for x in sorted(shapes[k])]) for k in names]
        close = [(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and np.abs(arrays[i] - arrays[j]).max() < limit]
        if not close:
            return own
        node, root = forest(*(np.array(x) for x in zip(*close, strict=True)))
        to = F.create_map(*[F.lit(int(v)) for pair in zip(node, root, strict=True) for v in pair])
        labels = own.withColumn("cluster_label", F.coalesce(F.try_element_at(to, F.col("cluster_label").cast("int")).cast("long"), "cluster_label"))
