"""Isotonic split of whole tables (K11): parcels merge where the line between two of them shows one mode, and share rows anew where it shows two.

Rows stay in tasks. Sums of each parcel and a histogram of each tested pair come to the driver, of bounded number and size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .density import labelled, points_of
from .graph import saved
from .neighbours import matrix

BINS = 128


def pooled(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising least-squares fit of y by pooling adjacent violators, and the squared error of the fit of each beginning of y (0 to all of it)."""
    level, weight, errors, square, total = [], [], [0.0], 0.0, 0.0
    for v in y.tolist():
        square += v * v
        level.append(v)
        weight.append(1)
        total += v * v
        while len(level) > 1 and level[-2] >= level[-1]:
            a, b, n, m = level[-2], level[-1], weight[-2], weight[-1]
            joint = (a * n + b * m) / (n + m)
            total += joint * joint * (n + m) - a * a * n - b * b * m
            level[-2:], weight[-2:] = [joint], [n + m]
        errors.append(square - total)
    return np.repeat(level, weight), np.array(errors)


def one_mode(counts: np.ndarray) -> np.ndarray:
    """The least-squares fit that rises, then falls."""
    y = counts.astype(float)
    left, right = pooled(y)[1], pooled(y[::-1])[1][::-1]
    top = int((left + right).argmin())
    return np.r_[pooled(y[:top])[0] if top else [], pooled(y[top:][::-1])[0][::-1] if top < len(y) else []]


def iso_cut(counts: np.ndarray, threshold: float = 1.3) -> int | None:
    """Where a histogram with two modes is cut: in the stretch where the counts lie most under the fit with one mode. None if that fit holds:
    the distribution functions of both differ by less than threshold / sqrt(rows). At 1.3 a hundredth of uniform samples, the hardest of one mode, are cut."""
    n = counts.sum()
    if n < 4:
        return None
    fit = one_mode(counts)
    if np.abs(np.cumsum(counts - fit)).max() / np.sqrt(n) < threshold:
        return None
    # the stretch that lacks most rows against the fit, and in it the middle of the lowest part of a fit that falls, then rises
    lack = np.r_[0, np.cumsum(fit - counts)]
    low = np.minimum.accumulate(lack)
    end = int((lack - low).argmax())
    begin = int(np.flatnonzero(lack[: end + 1] == low[end])[-1])
    valley = one_mode(-counts[begin:end])
    return begin + int(np.median(np.flatnonzero(valley == valley.max())))


def _sums(rows: DataFrame, d: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of each parcel its rows, centre and covariance."""
    width = 1 + d + d * d

    def part(batches):
        for batch in batches:
            k, x = batch.column("_k").to_numpy(), matrix(batch.column("_x"))
            names = np.unique(k)
            flat = np.array([np.r_[len(own), own.sum(0), (own.T @ own).ravel()] for own in (x[k == name] for name in names)]).reshape(len(names), width)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(flat.tolist(), pa.list_(pa.float64()))], ["_k", "_s"])

    total = rows.select("_k", "_x").mapInArrow(part, "_k long, _s array<double>").groupBy("_k").agg(*[F.sum(F.col("_s")[i]).alias(f"s{i}") for i in range(width)])
    out = {}
    for r in total.collect():  # a row a parcel
        s = np.array(r[1:])
        centre = s[1 : 1 + d] / s[0]
        out[r["_k"]] = (s[0], centre, s[1 + d :].reshape(d, d) / s[0] - np.outer(centre, centre))
    return out


def _pairs(parcels: dict, tested: set) -> list[tuple[int, int, np.ndarray]]:
    """Parcels that are each other's nearest among those not tested as they are, with the direction that parts them best."""
    names = sorted(parcels)
    nearest = {}
    for a in names:
        open_ = [(float(((parcels[a][1] - parcels[b][1]) ** 2).sum()), b) for b in names if b != a and (min(a, b), max(a, b)) not in tested]
        if open_:
            nearest[a] = min(open_)[1]
    out = []
    for a, b in nearest.items():
        if a < b and nearest.get(b) == a:
            (n, ca, va), (m, cb, vb) = parcels[a], parcels[b]
            cov = (n * va + m * vb) / (n + m)
            cov = cov + np.eye(len(cov)) * (1e-6 * np.trace(cov) / len(cov) + 1e-12)
            line = np.linalg.solve(cov, cb - ca)
            size = np.linalg.norm(line)
            out.append((a, b, line / size if size else np.r_[1.0, np.zeros(len(cov) - 1)]))
    return out


def iso_split_table(features: DataFrame, id_col: str, vec: str = "features", parcels: int = 30, threshold: float = 1.3, rounds: int = 200, first: int = 0, seed: int = 0) -> DataFrame:
    """(id, cluster_label) for any number of rows, numbered by the smallest id of a cluster.

    K-means gives the parcels to start with. In a round the pairs of parcels that are each other's nearest are tested on the line between them: one mode
    makes them one parcel, two share their rows by the cut. A pair is tested again only when one of the two has changed; when none is left, all is stable.
    Rows without a vector, or with a null or NaN in it, get -1; rows that repeat an id are one point, at the smallest of their vectors; an empty table gives
    an empty result.
    """
    points = saved(points_of(features, id_col, vec).groupBy("_id").agg(F.min("_x").alias("_x")), "points")
    head, n = points.select(F.size("_x")).first(), points.count()
    if head is None:
        return features.select(id_col, F.lit(-1).cast("long").alias("cluster_label"))
    d, k = head[0], min(parcels, max(1, n // 4))
    state = points.withColumn("_k", F.lit(0).cast("long"))
    if k > 1:
        vectors = points.withColumn("_v", array_to_vector("_x"))
        state = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_p").fit(vectors).transform(vectors).select("_id", "_x", F.col("_p").cast("long").alias("_k"))
    state, tested = saved(state, "parcels"), set()
    for _ in range(rounds):
        found = _sums(state, d)
        pairs = _pairs(found, tested)
        if not pairs:
            break
        of = {name: i for i, (a, b, _) in enumerate(pairs) for name in (a, b)}
        lines = np.array([line for *_, line in pairs])

        def projected(batches, of=of, lines=lines):
            for batch in batches:
                names = batch.column("_k").to_numpy()
                pair = np.array([of.get(name, -1) for name in names.tolist()], np.int64)
                at = np.flatnonzero(pair >= 0)
                value = (matrix(batch.column("_x"))[at] * lines[pair[at]]).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(at)), pa.array(names[at]), pa.array(pair[at]), pa.array(value)], ["_id", "_k", "_pair", "_y"])

        along = saved(state.mapInArrow(projected, "_id long, _k long, _pair long, _y double"), "lines")
        ends = {r["_pair"]: (r["low"], r["high"]) for r in along.groupBy("_pair").agg(F.min("_y").alias("low"), F.max("_y").alias("high")).collect()}
        bounds = F.create_map(*[v for p, (low, high) in ends.items() for v in (F.lit(p), F.array(F.lit(low), F.lit((high - low) / BINS or 1.0)))])
        limits = F.element_at(bounds, F.col("_pair"))
        bins = F.least(F.floor((F.col("_y") - limits[0]) / limits[1]), F.lit(BINS - 1)).cast("int")
        placed = along.withColumn("_bin", bins)
        counts = {p: np.zeros(BINS) for p in ends}
        for r in placed.groupBy("_pair", "_bin").count().collect():  # bins times pairs
            counts[r["_pair"]][r["_bin"]] = r["count"]
        cuts = {p: iso_cut(c, threshold) for p, c in counts.items()}
        # below the cut rows go to the first of the pair, above it to the second; without one all go to the first
        cut = F.element_at(F.create_map(*[v for p, c in cuts.items() for v in (F.lit(p), F.lit(BINS if c is None else c))]), F.col("_pair"))
        pair_of = F.element_at(F.create_map(*[v for p, (a, b, _) in enumerate(pairs) for v in (F.lit(p).cast("long"), F.array(F.lit(a), F.lit(b)))]), F.col("_pair"))
        moved = saved(placed.select("_id", F.col("_k").alias("_was"), F.when(F.col("_bin") <= cut, pair_of[0]).otherwise(pair_of[1]).alias("_now")), "moved")
        changed = {r[0] for r in moved.filter("_was <> _now").select(F.explode(F.array("_was", "_now"))).distinct().collect()}
        tested = {t for t in tested if not changed & set(t)} | {(a, b) for p, (a, b, _) in enumerate(pairs) if cuts[p] is not None}
        if changed:
            state = saved(state.join(moved.select("_id", "_now"), "_id", "left").select("_id", "_x", F.coalesce("_now", "_k").alias("_k")), "parcels")
    names = state.groupBy("_k").agg(F.min("_id").alias("_cluster"))
    return labelled(features, id_col, saved(state.join(names, "_k").select("_id", "_cluster"), "named"), first)
