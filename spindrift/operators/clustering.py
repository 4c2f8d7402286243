"""Clustering of sampled features. kmeans and gmm run on the cluster; the others work on one sample at a time, of a size that the sampler bounds,
in as many groups at once as there are."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOISE = -1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _roots(n: int, links) -> np.ndarray:
    parent = np.arange(n)
    for a, b in links:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    for i in range(n):
        parent[i] = parent[parent[i]]
    return parent


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Labels 0, 1, ... by first appearance; negative keys stay."""
    out, seen = np.full(len(keys), NOISE), {}
    for i, k in enumerate(keys.tolist()):
        if k >= 0:
            out[i] = seen.setdefault(k, len(seen))
    return out


def dbscan(x: np.ndarray, eps: float = 3.0, min_samples: int = 5) -> np.ndarray:
    """Density-connected clusters (K06); -1 is noise."""
    d = distances(x, x)
    near = d <= eps
    core = near.sum(1) >= min_samples
    ids = np.flatnonzero(core)
    label = np.full(len(x), NOISE)
    current = 0
    for start in ids.tolist():
        if label[start] >= 0:
            continue
        label[start], front = current, [start]
        while front:
            i = front.pop()
            if core[i]:
                fresh = np.flatnonzero(near[i] & (label < 0))
                label[fresh] = current
                front += fresh.tolist()
        current += 1
    return label


def spanning_tree(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Prim's minimum spanning tree of a distance matrix, edges by rising length."""
    n = len(d)
    best, source, left = d[0].copy(), np.zeros(n, int), np.ones(n, bool)
    left[0], out = False, []
    for _ in range(n - 1):
        j = int(np.where(left, best, np.inf).argmin())
        out.append((int(source[j]), j, float(best[j])))
        left[j] = False
        closer = left & (d[j] < best)
        best[closer], source[closer] = d[j][closer], j
    return sorted(out, key=lambda e: e[2])


def hdbscan(x: np.ndarray, min_cluster_size: int = 20, min_samples: int | None = None) -> np.ndarray:
    """Clusters of the condensed single-linkage tree of mutual reachability, chosen by stability (K07); -1 is noise."""
    n = len(x)
    if n < max(2, min_cluster_size):
        return np.full(n, NOISE)
    d = distances(x, x)
    k = min(n - 1, (min_samples or min_cluster_size) - 1)
    core = np.partition(d, k, axis=1)[:, k]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    # single linkage: node n + i joins two nodes at a height
    top, members, height, kids = list(range(n)), [1] * n, [0.0] * n, {}

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b, w in spanning_tree(reach):
        a, b, node = find(a), find(b), len(top)
        top.append(node)
        top[a] = top[b] = node
        members.append(members[a] + members[b])
        height.append(w)
        kids[node] = (a, b)
    # walk down: a split counts only where both sides are large
    born, stability, parts, falls = {0: 0.0}, {0: 0.0}, {0: []}, [[] for _ in range(1)]
    stack = [(len(top) - 1, 0)]
    while stack:
        node, c = stack.pop()
        if node < n:
            falls[c].append(node)
            continue
        density = 1 / height[node] if height[node] > 0 else 1e12
        big = [s for s in kids[node] if members[s] >= min_cluster_size]
        if len(big) == 2:
            stability[c] += members[node] * (density - born[c])
            for s in big:
                new = len(born)
                born[new], stability[new], parts[new] = density, 0.0, []
                falls.append([])
                parts[c].append(new)
                stack.append((s, new))
            continue
        for s in kids[node]:
            if s in big:
                stack.append((s, c))
            else:
                stability[c] += members[s] * (density - born[c])
                below = [s]
                while below:
                    m = below.pop()
                    if m < n:
                        falls[c].append(m)
                    else:
                        below += kids[m]
    chosen = set()
    for c in range(len(born) - 1, -1, -1):  # children have larger numbers
        inner = sum(stability[s] for s in parts[c])
        if parts[c] and (c == 0 or inner > stability[c]):
            stability[c] = inner
        elif c:
            chosen.add(c)
    keys = np.full(n, NOISE)

    def paint(c: int, key: int) -> None:
        todo = [c]
        while todo:
            e = todo.pop()
            keys[falls[e]] = key
            todo += parts[e]

    todo = [0]
    while todo:
        c = todo.pop()
        if c in chosen:
            paint(c, c)
        else:
            todo += parts[c]
    return _numbered(keys)


def agglomerative(x: np.ndarray, n_clusters: int = 2) -> np.ndarray:
    """Ward's hierarchy cut at n_clusters (K05), by chains of nearest neighbours."""
    n = len(x)
    centre, size, alive = [*x.astype(float)], [1] * n, set(range(n))
    merges, chain = [], []

    def cost(a: int, others: list[int]) -> np.ndarray:
        s = np.array([size[o] for o in others])
        gap = np.array([centre[o] for o in others]) - centre[a]
        return size[a] * s / (size[a] + s) * (gap * gap).sum(1)

    while len(alive) > 1:
        if not chain:
            chain = [min(alive)]
        a = chain[-1]
        others = sorted(alive - {a})
        c = cost(a, others)
        b = others[int(c.argmin())]
        if len(chain) > 1 and cost(a, [chain[-2]])[0] <= c.min():
            b = chain[-2]
            merges.append((float(cost(a, [b])[0]), a, b, len(centre)))
            centre.append((size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b]))
            size.append(size[a] + size[b])
            alive -= {a, b}
            alive.add(len(centre) - 1)
            chain = chain[:-2]
        else:
            chain.append(b)
    inside = {i: [i] for i in range(n)}
    links = []
    for rank, (_, a, b, new) in enumerate(sorted(merges, key=lambda m: m[3])):
        inside[new] = inside[a] + inside[b]
    for _, a, b, _ in sorted(merges)[: max(0, n - n_clusters)]:
        links.append((inside[a][0], inside[b][0]))
    return _numbered(_roots(n, links))


def optics(x: np.ndarray, min_samples: int = 5, max_eps: float = np.inf, eps: float | None = None) -> np.ndarray:
    """Reachability order, cut at eps (default: the 90 % quantile of finite reachabilities times 1.5)."""
    n = len(x)
    d = distances(x, x)
    k = min(n - 1, min_samples - 1)
    core = np.partition(d, k, axis=1)[:, k]
    core[core > max_eps] = np.inf
    reach, done, order = np.full(n, np.inf), np.zeros(n, bool), []
    for _ in range(n):
        open_ = np.where(done, np.inf, reach)
        i = int(open_.argmin()) if np.isfinite(open_).any() else int(np.flatnonzero(~done)[0])
        done[i] = True
        order.append(i)
        if np.isfinite(core[i]):
            new = np.maximum(core[i], d[i])
            better = ~done & (new < reach) & (d[i] <= max_eps)
            reach[better] = new[better]
    finite = reach[np.isfinite(reach)]
    cut = eps if eps is not None else (1.5 * np.quantile(finite, 0.9) if len(finite) else 0.0)
    keys, current = np.full(n, NOISE), -1
    for i in order:
        if reach[i] > cut:
            if core[i] <= cut:
                current += 1
                keys[i] = current
        else:
            keys[i] = max(current, 0)
    return _numbered(keys)


def meanshift(x: np.ndarray, bandwidth: float | None = None, rounds: int = 300) -> np.ndarray:
    """Modes of a flat kernel density (K10); points go to their nearest mode."""
    if bandwidth is None:
        d = distances(x, x)
        k = max(1, int(len(x) * 0.3)) - 1
        bandwidth = float(np.partition(d, k, axis=1)[:, k].mean()) or 1.0
    seeds = np.unique(np.round(x / bandwidth), axis=0) * bandwidth
    modes = []
    for m in seeds:
        for _ in range(rounds):
            near = x[np.sqrt(((x - m) ** 2).sum(1)) <= bandwidth]
            if not len(near):
                break
            new = near.mean(0)
            if np.sqrt(((new - m) ** 2).sum()) < 1e-3 * bandwidth:
                modes.append((len(near), tuple(new)))
                break
            m = new
    kept: list[np.ndarray] = []
    for _, m in sorted(set(modes), reverse=True):
        if all(np.sqrt(((np.array(m) - o) ** 2).sum()) > bandwidth for o in kept):
            kept.append(np.array(m))
    return distances(x, np.array(kept)).argmin(1) if kept else np.zeros(len(x), int)


def density_minima(values: np.ndarray, bandwidth: float = 1.0, step: float = 0.1) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Grid, Gaussian density and the indices of its minima."""
    low, high = values.min() - 3 * bandwidth, values.max() + 3 * bandwidth
    grid = np.arange(low, high + step, step)
    counts, _ = np.histogram(values, np.r_[grid - step / 2, grid[-1] + step / 2])
    reach = int(4 * bandwidth / step)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) * step / bandwidth) ** 2)
    density = np.convolve(counts, kernel / kernel.sum(), "same")
    inner = np.flatnonzero((density[1:-1] < density[:-2]) & (density[1:-1] <= density[2:])) + 1
    return grid, density, inner.tolist()


def saw_chain_cut(amplitudes: np.ndarray, threshold: float, nb_min: int = 20, bandwidth: float = 1.0, contrast: float = 0.3, max_loop: int = 1000, nb_remain: int = 30) -> np.ndarray:
    """Clusters cut off one after the other at density minima of amplitudes.

    amplitudes: (peak, channel), positive outward. The channel with the largest 90th percentile above threshold is cut at
    its last deep enough minimum; what lies beyond is a cluster. Channels without a cut are passed over.
    """
    label = np.full(len(amplitudes), NOISE)
    free, skipped, current = np.ones(len(amplitudes), bool), set(), 0
    for _ in range(max_loop):
        if free.sum() <= nb_remain:
            break
        top = np.percentile(amplitudes[free], 90, axis=0)
        order = [c for c in np.argsort(-top).tolist() if c not in skipped and top[c] > threshold]
        if not order:
            break
        c = order[0]
        values = amplitudes[free, c]
        grid, density, minima = density_minima(values, bandwidth)
        cut = None
        for m in reversed(minima):
            beyond, before = density[m:].max(), density[:m].max()
            size = int((values > grid[m]).sum())
            if grid[m] > threshold and size >= nb_min and 1 - density[m] / min(beyond, before) >= contrast:
                cut = grid[m]
                break
        if cut is None:
            alone = values > threshold
            if alone.sum() >= nb_min and np.percentile(values[alone], 10) > threshold + 1:
                cut = threshold
            else:
                skipped.add(c)
                continue
        chosen = np.flatnonzero(free)[values > cut]
        label[chosen] = current
        free[chosen] = False
        current += 1
        skipped.clear()
    return label


def pruning_shears(features: np.ndarray, channel_of: np.ndarray, peak_channel: np.ndarray, amplitude: np.ndarray, adjacent: np.ndarray, min_cluster_size: int = 20, nb_max: int = 1000, n_components: int = 3, tired: set | None = None, cluster: Callable[[np.ndarray, int], np.ndarray] = hdbscan) -> np.ndarray:
    """Clusters peeled off channel by channel.

    The next channel is that with the largest 90th percentile of amplitude among those with enough free peaks. Free peaks of adjacent channels
    are reduced by SVD on the features of these channels and clustered; the cluster of largest amplitude on the visited channel is kept.
    tired: channels that gave none since the last cluster. One whose adjacent peaks are still those of that visit is not clustered again.
    """
    label = np.full(len(features), NOISE)
    free, tired, current = np.ones(len(features), bool), set(tired or ()), 0
    gave_none: dict[int, int] = {}
    for _ in range(nb_max):
        best, at = -np.inf, -1
        for c in np.unique(peak_channel[free]).tolist():
            own = amplitude[free & (peak_channel == c)]
            if c not in tired and len(own) > min_cluster_size and np.percentile(own, 90) > best:
                best, at = float(np.percentile(own, 90)), c
        if at < 0:
            break
        near = np.flatnonzero(free & adjacent[at][peak_channel])
        if gave_none.get(at) == len(near):  # free peaks only become fewer
            tired.add(at)
            continue
        x = features[near][:, adjacent[at][channel_of]]
        _, _, v = np.linalg.svd(x, full_matrices=False)
        found = cluster(x @ v[:n_components].T, min_cluster_size)
        sizes = {k: near[found == k] for k in range(found.max() + 1)}
        good = {k: m for k, m in sizes.items() if len(m) >= min_cluster_size and (peak_channel[m] == at).mean() > 0.5}
        if not good:
            own = near[peak_channel[near] == at]
            if len(own) >= min_cluster_size and not sizes:
                good = {0: own}
            else:
                tired.add(at)
                gave_none[at] = len(near)
                continue
        kept = max(good.values(), key=lambda m: float(np.median(amplitude[m])))
        label[kept] = current
        free[kept] = False
        current += 1
        tired.clear()
    return label


KERNELS: dict[str, Callable[..., np.ndarray]] = {"dbscan": dbscan, "hdbscan": hdbscan, "agglomerative": agglomerative, "optics": optics, "meanshift": meanshift, "onecluster": lambda x: np.zeros(len(x), int)}


#: A kernel's distance matrix of this many rows takes 3.2 GB.
MAX_SAMPLE = 20_000


def check_sample(rows: DataFrame, keys: list[str], most: int | None) -> None:
    """Refuse samples that one task could not hold."""
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0 if most else 0
    if most and largest > most:
        raise ValueError(f"a sample of {largest} rows is too large for one task, at most {most}: sample the rows first")


def find_on_selection(peaks: DataFrame, features: DataFrame, method: str, id_col: str = "peak_id", label: str = "cluster_label", **options) -> DataFrame:
    """peaks with the rows that features names clustered anew: their labels follow the largest in use (K01 on a selection)."""
    top = peaks.agg(F.max(label)).first()[0]
    found = find_clusters(features, id_col, method, first=max(-1 if top is None else top, -1) + 1, **options)
    new = found.select(id_col, F.col("cluster_label").alias("_new"))
    return peaks.join(new, id_col, "left").withColumn(label, F.coalesce("_new", label)).drop("_new")


def _whole(method: str) -> Callable[..., DataFrame]:
    from . import density, hierarchy, isosplit, linkage, modes

    tables = {"isosplit5": isosplit.iso_split_table, "dbscan": density.dbscan_table, "hdbscan": linkage.hdbscan_table, "dbscan_with_noise": linkage.hdbscan_table, "agglomerative": hierarchy.ward_table, "meanshift": modes.mean_shift_table}
    if method not in tables:
        raise ValueError(f"{method} works on samples only; on whole tables: {', '.join(tables)}")
    return tables[method]


def find_clusters(features: DataFrame, id_col: str, method: str, vec: str = "features", keys: list[str] | None = None, noise: DataFrame | None = None, first: int = 0, seed: int = 0, max_rows: int = MAX_SAMPLE, whole: bool = False, **options) -> DataFrame:
    """(id, cluster_label) by method name (K01). keys part the rows into independent samples; first is added to valid labels.

    Kernels compare all rows of a sample, so a sample of more than max_rows is refused: take one with relational.sample_total first.
    whole: cluster all rows together on the cluster instead, with no bound on their number; for dbscan, hdbscan, dbscan_with_noise, agglomerative and
    meanshift (modules density, linkage, hierarchy, modes) and isosplit5 (which has no kernel), whose labels are those of the kernels, numbered by the smallest id.

    dbscan_with_noise (K08) clusters features and noise rows together by hdbscan, then leaves the noise rows out.
    """
    if method in ("kmeans", "gmm"):
        vectors = features.select(id_col, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
        k = options.pop("n_clusters")
        model = KMeans(k=k, seed=seed, featuresCol="_v", **options) if method == "kmeans" else GaussianMixture(k=k, seed=seed, featuresCol="_v", **options)
        out = model.fit(vectors).transform(vectors)
        return out.select(id_col, (F.col("prediction") + first).cast("long").alias("cluster_label"))
    if method == "onecluster" and not keys:
        return features.select(id_col, F.lit(first).cast("long").alias("cluster_label"))
    if whole:
        if keys:
            raise ValueError("rows are clustered either by keys or as a whole")
        return _whole(method)(features, id_col, vec, first=first, **options | ({"noise": noise} if method == "dbscan_with_noise" else {}))
    if method == "dbscan_with_noise":
        method, extra = "hdbscan", noise
    else:
        extra = None
    kernel = KERNELS[method]
    rows = features.select(id_col, *(keys or []), F.col(vec).cast("array<double>").alias("_x"), F.lit(True).alias("_real"))
    if extra is not None:
        rows = rows.unionByName(extra.select(F.lit(None).cast(dict(rows.dtypes)[id_col]).alias(id_col), F.col(vec).cast("array<double>").alias("_x"), F.lit(False).alias("_real")))

    check_sample(rows, keys or [], max_rows if method != "onecluster" else None)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_real", id_col], ascending=[False, True])
        labels = kernel(np.stack(pdf["_x"].to_numpy()), **options)
        out = pd.DataFrame({**{k: pdf[k] for k in keys or []}, id_col: pdf[id_col], "cluster_label": np.where(labels >= 0, labels + first, labels)})
        return out[pdf["_real"].to_numpy()]

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys or []), f"`{id_col}` {kinds[id_col]}", "cluster_label long"])
    return rows.groupBy(*(keys or [])).applyInPandas(run, schema)


# --- unimodality


HULL_BLOCK = 1 << 16


def _hull(u: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the greatest convex minorant: points on or above the line of their neighbours go, block by block, then all together; what goes slowly is left to one scan."""

    def thinned(keep: np.ndarray) -> np.ndarray:
        while len(keep) > 2:
            du, dy = np.diff(u[keep]), np.diff(y[keep])
            above = dy[:-1] * du[1:] >= dy[1:] * du[:-1]
            gone = int(above.sum())
            if gone:
                keep = keep[np.r_[True, ~above, True]]
            if gone * 16 < len(above):
                break
        return keep

    keep = thinned(np.concatenate([thinned(np.arange(i, min(i + HULL_BLOCK, len(u)))) for i in range(0, len(u), HULL_BLOCK)]))
    us, ys, out = u[keep].tolist(), y[keep].tolist(), []
    for i in range(len(us)):
        while len(out) > 1 and (ys[out[-1]] - ys[out[-2]]) * (us[i] - us[out[-1]]) >= (ys[i] - ys[out[-1]]) * (us[out[-1]] - us[out[-2]]):
            out.pop()
        out.append(i)
    return keep[out]


def dip(values: np.ndarray, counts: np.ndarray | None = None) -> float:
    """Hartigan's dip: half the least largest distance between the empirical distribution and a unimodal one. counts: how often each value occurs."""
    xs = np.asarray(values, float)
    if counts is None and len(xs) > 4:
        xs = np.sort(xs)
        if (xs[1:] == xs[:-1]).any():
            xs, counts = np.unique(xs, return_counts=True)
    elif counts is not None:
        order = np.argsort(xs)
        xs, counts = xs[order], np.asarray(counts)[order]
    if len(xs) <= 4:
        return 0.0
    total = np.arange(1, len(xs) + 1) if counts is None else np.cumsum(counts)
    n = int(total[-1])
    upper = total / n
    lower = np.r_[0, upper[:-1]]
    low, high, best = 0, len(xs) - 1, 1.0 / n
    while True:
        u, below, over = (v[low : high + 1] for v in (xs, lower, upper))
        minor, major = _hull(u, below), _hull(u, -over)
        at = np.union1d(minor, major)
        gap = np.interp(u[at], u[major], over[major]) - np.interp(u[at], u[minor], below[minor])
        d = float(gap.max())
        if d <= best:
            return best / 2
        k = int(at[gap.argmax()])
        left = int(minor[minor <= k].max(initial=0))
        right = int(major[major >= k].min(initial=len(u) - 1))
        if k in minor and k not in major:
            left = k
        elif k in major and k not in minor:
            right = k
        first, last = slice(0, left + 1), slice(right, len(u))
        outside = max(float((over[first] - np.interp(u[first], u[minor], below[minor])).max(initial=0)), float((np.interp(u[last], u[major], over[major]) - below[last]).max(initial=0)))
        best = max(best, outside)
        if left == 0 and right == len(u) - 1:
            return max(best, d) / 2
        low, high = low + left, low + right


def null_dip(n: int, draw: int, seed: int = 0) -> float:
    """The dip of one of a row of uniform samples of n values; any of them can be drawn alone."""
    r = np.random.default_rng(seed)
    r.bit_generator.advance(draw * n)
    return dip(r.uniform(size=n))


def dip_test(values: np.ndarray, draws: int = 1000, seed: int = 0) -> tuple[float, float | None]:
    """The dip and its p-value against uniform samples of the same size."""
    own = dip(values)
    if len(np.unique(values)) <= 4:
        return 0.0, 1.0
    null = np.array([null_dip(len(values), k, seed) for k in range(draws)])
    if not null.any():
        return own, None
    return own, float(((own < null).sum() + 1) / (draws + 1))


def dip_by_group(df: DataFrame, keys: list[str], value: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """keys, dip, p: one test per group on all its values; a group comes to its task as distinct values with counts. Null values are left out.

    Uniform samples are drawn and measured in tasks of their own, once for all groups of one size.
    """
    from .graph import saved

    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = dip(pdf["_v"].to_numpy(), pdf["_n"].to_numpy())
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "dip": [d], "_size": [pdf["_n"].sum() if len(pdf) > 4 else 0]})

    def measured(batches):
        for pdf in batches:
            yield pd.DataFrame({"_size": pdf["_size"], "_dip": [null_dip(n, k, seed) for n, k in zip(pdf["_size"].tolist(), pdf["_draw"].tolist(), strict=True)]})

    kinds = dict(df.dtypes)
    own = saved(counted.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "dip double", "_size long"])), "dips")
    sizes = own.filter("_size > 0").select("_size").distinct()
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    drawn = sizes.withColumn("_draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long")))).repartition(tasks, "_size", "_draw")
    null = drawn.mapInPandas(measured, "_size long, _dip double").groupBy("_size").agg(F.collect_list("_dip").alias("_null"))
    over = F.size(F.filter("_null", lambda x: x > F.col("dip")))
    return own.join(null, "_size", "left").select(*keys, "dip", F.when(F.col("_size") == 0, 1.0).otherwise((over + 1) / F.lit(draws + 1)).alias("p"))


def auto_split(features: DataFrame, id_col: str, label: str = "cluster_label", vec: str = "features", p_value: float = 0.1, min_cluster_size: int = 20, seed: int = 0, sample: int = 4096) -> DataFrame:
    """(id, label, part): clusters whose first component is not unimodal are split by hdbscan on two components.

    part is 0 where a cluster stays whole, else 0, 1, ... for its pieces and -1 for what is trashed. Clusters of at most `sample` rows run in parallel,
    one in a task each; larger ones one after the other, each as a table: moments, dip test and clusters by Spark.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        x = np.stack(pdf["_x"].to_numpy())
        centred = x - x.mean(0)
        _, _, v = np.linalg.svd(centred, full_matrices=False)
        part = np.zeros(len(x), int)
        if len(x) >= 2 * min_cluster_size:
            _, p = dip_test(centred @ v[0], 100, seed)
            if p is not None and p < p_value:
                found = hdbscan(centred @ v[:2].T, min_cluster_size)
                part = found if found.max() > 0 else part
        return pd.DataFrame({id_col: pdf[id_col], label: pdf[label], "part": part})

    kinds = dict(features.dtypes)
    rows = features.select(id_col, label, F.col(vec).cast("array<double>").alias("_x"))
    large = [r[label] for r in rows.groupBy(label).count().filter(F.col("count") > sample).select(label).orderBy(label).collect()]  # as many as a catalogue has
    small = rows.filter(~F.coalesce(F.col(label).isin(large), F.lit(False))) if large else rows
    out = small.groupBy(label).applyInPandas(run, f"`{id_col}` {kinds[id_col]}, `{label}` {kinds[label]}, part long")
    for k in large:
        out = out.unionByName(_split_table(rows.filter(F.col(label).eqNullSafe(F.lit(k))), id_col, label, p_value, min_cluster_size, seed))
    return out


def _split_table(rows: DataFrame, id_col: str, label: str, p_value: float, min_cluster_size: int, seed: int) -> DataFrame:
    """One cluster of auto_split as a table: id, label, _x."""
    from .features import gram, singular_vectors, transform
    from .graph import saved

    size = rows.select(F.size("_x").alias("n")).first()["n"]
    mean = rows.agg(*[F.avg(F.col("_x")[i]).alias(f"m{i}") for i in range(size)]).first()
    centred = rows.select(id_col, label, F.array(*[F.col("_x")[i] - F.lit(mean[i]) for i in range(size)]).alias("_x"))
    _, v = singular_vectors(gram(centred, "_x")[()][1], 2)
    flat = saved(transform(centred, id_col, "_x", v), "split")
    (test,) = dip_by_group(flat.select(F.lit(0).alias("_all"), F.col("features")[0].alias("_p")), ["_all"], "_p", 100, seed).collect()
    whole = rows.select(id_col, label, F.lit(0).cast("long").alias("part"))
    if test["p"] >= p_value:
        return whole
    found = find_clusters(flat, id_col, "hdbscan", whole=True, min_cluster_size=min_cluster_size)
    if (found.agg(F.max("cluster_label")).first()[0] or 0) <= 0:
        return whole
    return found.select(id_col, F.col("cluster_label").alias("part")).join(rows.select(id_col, label), id_col).select(id_col, label, "part")


def close_templates(a: np.ndarray, b: np.ndarray, limit: float = 2.3, share: float = 0.3, shift: int = 2) -> bool:
    """Whether two centroids (sample, channel) differ little at some shift."""
    bound = max(share * max(np.abs(a).max(), np.abs(b).max()), limit)
    inner = a[shift : len(a) - shift]
    return any(np.abs(inner - b[shift + s : len(b) - shift + s]).max() < bound for s in range(-shift, shift + 1))


def overlapping(x: np.ndarray, y: np.ndarray, quantile: float = 0.9) -> bool:
    """Whether the projections of two clusters on the line between their medians overlap."""
    mx, my = np.median(x, axis=0), np.median(y, axis=0)
    line = my - mx
    size = float(line @ line)
    if not size:
        return True
    px, py = (x - mx) @ line / size, (y - mx) @ line / size
    return bool(np.quantile(px, quantile) >= np.quantile(py, 1 - quantile))


def split_labels(parts: DataFrame, label: str = "cluster_label") -> DataFrame:
    """parts of auto_split with one label a piece: the first keeps its cluster's, the others get new ones, trash becomes -1.

    The numbering runs over one row per piece.
    """
    from pyspark.sql import Window

    top = parts.agg(F.max(label)).first()[0] or 0
    pieces = parts.filter("part > 0").select(label, "part").distinct()
    named = pieces.withColumn("_new", (F.row_number().over(Window.orderBy(label, "part")) + top).cast("long"))
    out = parts.join(F.broadcast(named), [label, "part"], "left")
    return out.withColumn(label, F.when(F.col("part") < 0, -1).otherwise(F.coalesce("_new", label)).cast("long")).drop("part", "_new")


def merge_pairs_in_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(old, new) of pairs i < j taken in order: j becomes i; a label that has gone is no partner any more."""
    gone: dict[int, int] = {}
    for i, j in sorted(pairs):
        if i not in gone and j not in gone:
            gone[j] = i
    return sorted(gone.items())


def auto_merge(waves: DataFrame, centres: DataFrame, together: DataFrame, label: str = "cluster_label", wave: str = "wf", limit: float = 2.3, share: float = 0.3, shift: int = 2, quantile: float = 0.9) -> DataFrame:
    """(old, new) of clusters that are one (K17): pairs that share channels, whose centroids differ little at some shift and whose waveforms overlap.

    waves: a sample of each cluster's waveforms, of bounded size. centres: label, offset, channel, median. together: label_i, label_j, together
    (waveforms.shared_channels). Centroids come to the driver, as many as a catalogue has; waveforms meet pair by pair in tasks.
    """
    spark = waves.sparkSession
    found: dict[int, dict] = {}
    for r in centres.select(label, "offset", "channel", "median").collect():  # a catalogue's centroids
        found.setdefault(r[0], {})[r["offset"], r["channel"]] = r["median"]
    shape = {k: (sorted({o for o, _ in c}), sorted({ch for _, ch in c})) for k, c in found.items()}
    templates = {k: np.array([[c[o, ch] for ch in shape[k][1]] for o in shape[k][0]]) for k, c in found.items()}
    shared = {(r["label_i"], r["label_j"]) for r in together.filter("together and label_i < label_j").collect()}
    close = [(i, j) for i, j in sorted(shared) if i in templates and j in templates and templates[i].shape == templates[j].shape and close_templates(templates[i], templates[j], limit, share, shift)]
    none = spark.createDataFrame([], "old long, new long")
    if not close:
        return none
    pairs = F.broadcast(spark.createDataFrame([(i, j, k) for i, j in close for k in (i, j)], "label_i long, label_j long, _own long"))
    rows = waves.select(F.col(label).cast("long").alias("_own"), F.col(wave).cast("array<double>").alias("_x")).join(pairs, "_own")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["label_i"].iloc[0]), int(pdf["label_j"].iloc[0])
        a, b = (np.stack(pdf.loc[pdf["_own"] == k, "_x"].to_numpy()) for k in (i, j))
        return pd.DataFrame({"label_i": [i], "label_j": [j], "same": [overlapping(a, b, quantile)]})

    both = rows.groupBy("label_i", "label_j").agg(F.countDistinct("_own").alias("_n")).filter("_n = 2").select("label_i", "label_j")
    judged = rows.join(both, ["label_i", "label_j"]).groupBy("label_i", "label_j").applyInPandas(run, "label_i long, label_j long, same boolean")
    merges = merge_pairs_in_order([(r["label_i"], r["label_j"]) for r in judged.filter("same").collect()])
    return spark.createDataFrame(merges, "old long, new long") if merges else none
