"""HDBSCAN of points of few dimensions in one task: leaves of a k-d tree stand for the distance matrix, so memory grows with the rows, not their square."""

from __future__ import annotations

import numpy as np

from .neighbours import gaps

LEAF = 64
#: Leaves that one leaf is compared with at once.
AT_ONCE = 128


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a and b, the sums of neighbours.gaps."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        diff = a[:, k, None] - b[None, :, k]
        diff *= diff
        out += diff
    return out


class Leaves:
    """Points in the order of their leaves: x[LEAF * a : LEAF * (a + 1)] lies in the box low[a], high[a]. order: the rows that they come from."""

    def __init__(self, x: np.ndarray, size: int = LEAF):
        self.size, parts, done = size, [np.arange(len(x))], []
        while parts:
            rows = parts.pop()
            if len(rows) <= size:
                done.append(rows)
                continue
            own = x[rows]
            half = size * -(-len(rows) // (2 * size))  # all leaves but the last are full
            by = np.argpartition(own[:, int((own.max(0) - own.min(0)).argmax())], half - 1)
            parts += [rows[by[half:]], rows[by[:half]]]
        self.order = np.concatenate(done)
        self.x = x[self.order]
        starts = np.arange(0, len(x), size)
        self.low, self.high = np.minimum.reduceat(self.x, starts), np.maximum.reduceat(self.x, starts)

    def apart(self, a: int) -> np.ndarray:
        """Of each leaf the distance of its box from that of leaf a."""
        gap = np.maximum(np.maximum(self.low - self.high[a], self.low[a] - self.high), 0)
        return np.sqrt((gap * gap).sum(1)) * (1 - 1e-12)

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        at = (leaves[:, None] * self.size + np.arange(self.size)).ravel()
        return at[at < len(self.x)]

    def nearest(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, k) the k nearest other rows and their distances, by rising distance."""
        n = len(self.x)
        at, d = np.zeros((n, k), int), np.zeros((n, k))
        for a in range(len(self.low)):
            own = np.arange(a * self.size, min(n, (a + 1) * self.size))
            x, apart = self.x[own], self.apart(a)
            apart[a] = -1.0
            leaves = np.argsort(apart, kind="stable")
            best_at, best = np.zeros((len(own), k), int), np.full((len(own), k), np.inf)
            begin, take = 0, 2 if len(own) <= k else 1  # the leaf itself comes first
            while begin < len(leaves) and (not begin or apart[leaves[begin]] ** 2 < best.max()):
                near = leaves[begin : begin + take]
                others = self.rows(near[(apart[near] < 0) | (apart[near] ** 2 < best.max())])
                w = squares(x, self.x[others])
                if not begin:
                    w[own[:, None] == others[None]] = np.inf
                begin, take = begin + take, min(2 * take + 10, AT_ONCE)
                i, j = np.nonzero(w < best[:, -1:])
                row, value, place = np.r_[np.repeat(np.arange(len(own)), k), i], np.r_[best.ravel(), w[i, j]], np.r_[best_at.ravel(), others[j]]
                by = np.lexsort((value, row))
                start = np.searchsorted(row[by], np.arange(len(own)))
                by = by[start[:, None] + np.arange(k)]
                best, best_at = value[by], place[by]
            at[own], d[own] = best_at, np.sqrt(best)
        return at, d


def spanning_edges(leaves: Leaves, core: np.ndarray, near: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, weight) of a minimum spanning tree of mutual reachability, in rounds in which each component takes a least edge to another.

    Lists of near rows bound that edge from above. Rows whose list may lack a shorter one look into leaves that hold another component and are near enough. Of edges of one
    weight any may be taken: a component takes one only if nothing lighter leaves it, so only circles of taken edges are to be left out.
    """
    n, size = len(core), leaves.size
    comp, top, out = np.arange(n), list(range(n)), []
    listed = np.maximum(np.maximum(d, core[:, None]), core[near])
    beyond = np.maximum(core, d[:, -1])  # rows that are not listed weigh no less
    starts = np.arange(0, n, size)
    least_core = np.minimum.reduceat(core, starts)

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    while len(out) < n - 1:
        w = np.where(comp[near] != comp[:, None], listed, np.inf)
        pick = w.argmin(1)
        rows = np.arange(n)
        w, q = w[rows, pick], near[rows, pick]
        owner, end_p, end_q, weight = np.r_[comp, comp[q]], np.r_[rows, q], np.r_[q, rows], np.r_[w, w]
        by = np.lexsort((weight, owner))
        first = by[np.flatnonzero(np.r_[True, np.diff(owner[by]) != 0])]
        best, best_p, best_q = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, int)
        best[owner[first]], best_p[owner[first]], best_q[owner[first]] = weight[first], end_p[first], end_q[first]
        c_low, c_high = np.minimum.reduceat(comp, starts), np.maximum.reduceat(comp, starts)
        for a in np.unique(np.flatnonzero(beyond < best[comp]) // size).tolist():
            own = np.arange(a * size, min(n, (a + 1) * size))
            own = own[beyond[own] < best[comp[own]]]
            if not len(own):
                continue
            limit, apart = best[comp[own]].max(), leaves.apart(a)
            fit = (apart < limit) & (least_core < limit)
            if (comp[own] == comp[own[0]]).all():
                fit &= (c_low != comp[own[0]]) | (c_high != comp[own[0]])
            fit = np.flatnonzero(fit)
            fit, begin, take = fit[np.argsort(apart[fit], kind="stable")], 0, 8
            while begin < len(fit) and len(own) and apart[fit[begin]] < best[comp[own]].max():
                others = leaves.rows(fit[begin : begin + take])
                begin, take = begin + take, min(2 * take, AT_ONCE)
                others = others[core[others] < best[comp[own]].max()]
                if not len(others):
                    continue
                w = np.maximum(np.maximum(gaps(leaves.x[own], leaves.x[others]), core[own, None]), core[others][None])
                w[comp[own, None] == comp[others][None]] = np.inf
                at = w.argmin(1)
                low = w[np.arange(len(own)), at]
                for i in np.flatnonzero(low < best[comp[own]]).tolist():
                    c = comp[own[i]]
                    if low[i] < best[c]:
                        best[c], best_p[c], best_q[c] = low[i], own[i], others[at[i]]
                own = own[beyond[own] < best[comp[own]]]
        chosen = np.flatnonzero(np.isfinite(best))
        if not len(chosen):
            raise RuntimeError("points without a distance to any other")
        chosen = chosen[np.argsort(best[chosen], kind="stable")]
        for p, q, v in zip(best_p[chosen].tolist(), best_q[chosen].tolist(), best[chosen].tolist(), strict=True):
            a, b = find(p), find(q)
            if a != b:
                top[max(a, b)] = min(a, b)
                out.append((p, q, v))
        comp = np.array(top)
        while (comp[comp] != comp).any():
            comp = comp[comp]
    p, q, v = (np.array(c) for c in zip(*out, strict=True))
    return p, q, v


def condensed(p: np.ndarray, q: np.ndarray, w: np.ndarray, n: int, least: int) -> np.ndarray:
    """The chosen cluster that each of n rows is in, -1 for none: linkage.merged and linkage.topmost on one tree, in arrays."""
    top, size = list(range(n)), [1] * n
    cluster, total, left, below = [-1] * n, [0.0] * n, [0] * n, [-1.0] * n
    inside, fell = [[i] for i in range(n)], [-1] * n
    parent, chosen = [], []

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    def join(parts: list[int], density: float) -> None:
        parts.sort()
        new, open_ = parts[0], [r for r in parts if cluster[r] >= 0]
        m = sum(size[r] for r in parts)
        if len(open_) == 1:
            r = open_[0]
            state = cluster[r], total[r] + (m - size[r]) * density, left[r] + m - size[r], below[r]
        elif open_:
            best = 0.0
            for r in open_:
                stability = total[r] - size[r] * density
                parent[cluster[r]], chosen[cluster[r]] = len(parent), below[r] < 0 or below[r] <= stability
                best += stability if chosen[cluster[r]] else below[r]
            state = len(parent), m * density, m, best
        else:
            state = (len(parent), m * density, m, -1.0) if m >= least else (-1, 0.0, 0, -1.0)
        if state[0] == len(parent):
            parent.append(-1)
            chosen.append(False)
        kept = []
        for r in parts:
            if state[0] < 0:
                kept += inside[r]
            else:
                for i in inside[r]:
                    fell[i] = state[0]
            top[r], inside[r] = new, []
        size[new], inside[new] = m, kept
        cluster[new], total[new], left[new], below[new] = state

    by = np.argsort(w, kind="stable")
    p, q, w = p[by].tolist(), q[by].tolist(), w[by].tolist()
    begin = 0
    while begin < len(w):
        end = begin + 1
        while end < len(w) and w[end] == w[begin]:
            end += 1
        density = 1 / w[begin] if w[begin] > 0 else 1e12
        if end == begin + 1:
            join([find(p[begin]), find(q[begin])], density)
        else:  # what edges of one weight connect merges at once
            groups: dict[int, list[int]] = {}
            for a, b in zip(p[begin:end], q[begin:end], strict=True):
                a, b = find(a), find(b)
                one, two = groups.setdefault(a, [a]), groups.setdefault(b, [b])
                if one is not two:
                    one, two = (one, two) if len(one) >= len(two) else (two, one)
                    one += two
                    groups.update(dict.fromkeys(two, one))
            for parts in {id(g): g for g in groups.values()}.values():
                join(parts, density)
        begin = end
    found = [-1] * len(parent)
    for c in range(len(parent) - 1, -1, -1):  # a parent has the larger number; the last one is never chosen
        above = found[parent[c]] if parent[c] >= 0 else -1
        found[c] = above if above >= 0 else c if chosen[c] else -1
    return np.array([found[c] if c >= 0 else -1 for c in fell])


def hdbscan(x: np.ndarray, min_cluster_size: int = 20, min_samples: int | None = None) -> np.ndarray:
    """The labels of linkage.hdbscan_table, which are those of clustering.hdbscan but for rows that join two clusters at the very weight at which they meet; -1 is noise."""
    from .clustering import NOISE, _numbered

    n = len(x)
    if n < max(2, min_cluster_size):
        return np.full(n, NOISE)
    leaves = Leaves(x)
    k = min(n - 1, max(1, (min_samples or min_cluster_size) - 1))
    near, d = leaves.nearest(min(n - 1, k + 4))
    p, q, w = spanning_edges(leaves, d[:, k - 1].copy(), near, d)
    return _numbered(condensed(leaves.order[p], leaves.order[q], w, n, min_cluster_size))
