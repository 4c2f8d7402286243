from collections import Counter, defaultdict

import numpy as np
import pytest

from spindrift.llm import minmax

from .conftest import prose
from .test_jaccard import sets_of


def brute(rows, percent=85):
    sets, where, parent, shared = sets_of(rows), defaultdict(list), {}, Counter()
    for i, s in sets.items():
        parent[i] = i
        for x in s:
            where[x].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for ids in where.values():
        ids = sorted(ids)
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), c in shared.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width", [16, 1])
def test_odd_rows(odd, width, monkeypatch):
    monkeypatch.setattr(minmax, "WIDTH", width)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute([r for r in rows if r[0] is not None])
    got = minmax.near_components(odd).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minmax.near_components(documents).collect()} == brute(rows)


def test_buckets_of_several_components(spark, monkeypatch):
    """A chain of texts, each a few words further from the first, and a template whose fillings do not link: buckets go through several rounds."""
    monkeypatch.setattr(minmax, "WIDTH", 1)
    base = prose(1, 200).split()
    rows = [(i, " ".join([*base[3 * i :], *(f"new{i}-{j}" for j in range(3 * i))])) for i in range(30)]
    for i in range(60):
        w = prose(7, 150).split()
        for j in range(5, 150, 30):
            w[j] = f"slot{i}-{j}"
        rows.append((100 + i, " ".join(w)))
    # pairs of fillings that do link
    rows += [(200 + i, rows[30 + i][1] + " tail") for i in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax.near_components(df, rows=2).collect()}
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) > 50


def test_one_of_each_group_stays(odd):
    want = brute([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None])
    kept = minmax.first_of_each(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()} | {None}


def test_empty(empty):
    assert minmax.near_components(empty).count() == 0


def test_signatures_are_unbiased():
    r = np.random.default_rng(3)
    hasher, errors = minmax.MinMax(permutations=64), []
    for trial in range(60):
        a = r.integers(0, 1 << 63, 300).astype(np.uint64)
        keep = int(r.integers(100, 300))
        b = np.r_[a[:keep], r.integers(0, 1 << 63, 300 - keep).astype(np.uint64)]
        x, y = hasher.signatures([a, b])
        errors.append((x == y).mean() - keep / (600 - keep))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_bands_hold_values_of_different_permutations():
    assert minmax.BANDS * minmax.ROWS == 2 * minmax.PERMUTATIONS and minmax.PERMUTATIONS % minmax.ROWS == 0
    sig = np.arange(2 * minmax.PERMUTATIONS, dtype=np.uint32)[None]
    assert minmax.bands(np.vstack([sig, sig])).shape == (2, minmax.BANDS)
