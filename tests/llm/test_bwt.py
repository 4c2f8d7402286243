import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm.bwt import remove_repeats, shared_windows


def brute(rows, n):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s : s + n] for b in raws for s in range(len(b) - n + 1))
    out = []
    for (i, _), b in zip(rows, raws, strict=True):
        gone, last = bytearray(len(b)), 0
        for s in range(len(b) - n + 1):
            if seen[b[s : s + n]] > 1:
                for x in range(max(s, last), s + n):
                    gone[x] = 1
                last = s + n
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    return sorted(map(tuple, remove_repeats(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=3, max_size=40).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=6), st.integers(1, 12))
def test_interval_expansion_finds_shared_windows(texts, n):
    seen = Counter(t[s : s + n] for t in texts for s in range(len(t) - n + 1))
    for t, flags in zip(texts, shared_windows(texts, n), strict=True):
        assert [seen[t[s : s + n]] > 1 for s in range(len(t) - n + 1)] == flags.tolist()


@pytest.mark.parametrize("hot_contexts", [4096, 1])
def test_odd_rows(odd, hot_contexts):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd, hot_contexts=hot_contexts) == brute(rows, 200)


@pytest.mark.parametrize("hot_contexts", [4096, 2])
def test_documents(documents, hot_contexts):
    assert found(documents, hot_contexts=hot_contexts) == brute([(r.doc_id, r.text) for r in documents.collect()], 200)


def test_passage_in_many_surroundings(spark):
    """One passage in many texts: its borders are distinct contexts of hot keys, and are halved."""
    passage = " ".join(f"common{i}" for i in range(40))
    rows = [(i, f"{'lead' * (i % 9)} {i * 7919} {passage} {i * 104729} {'tail' * (i % 7)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, hot_contexts=3) == brute(rows, 200) == found(df)


def test_spans_are_whole(documents):
    for r in remove_repeats(documents).collect():
        assert sum(s["to"] - s["from"] for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed


def test_empty(empty):
    assert remove_repeats(empty).count() == 0
