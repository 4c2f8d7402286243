import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import periodic, queries


def runs_of(x, least=4, shortest=6):
    """All runs by trying every period."""
    smallest = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i < len(x) - q:
            s = i
            while i < len(x) - q and x[i] == x[i + q]:
                i += 1
            if i - s >= q:
                smallest.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in smallest.items() if n >= max(shortest, least * q)), key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9), st.integers(2, 4), st.sampled_from([1, 6]))
def test_runs(x, root, times, least, shortest):
    x = x[: len(x) // 2] + root * times + x[len(x) // 2 :]
    assert periodic.word_runs(np.array(x, np.int64), least, shortest) == runs_of(x, least, shortest)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
def test_lyndon_array(x):
    smaller, shared = periodic.lyndon_array(x)
    for i in range(len(x)):
        j = next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x))
        k = 0
        while j + k < len(x) and x[i + k] == x[j + k]:
            k += 1
        assert (smaller[i], shared[i]) == (j, k)


def test_extensions_are_reused():
    """Fibonacci words, powers and texts of one word: the words that are read stay in proportion to the length."""

    class Word(int):
        read = 0

        def __eq__(self, other):
            Word.read += 1
            return int(self) == int(other)

        def __gt__(self, other):
            Word.read += 1
            return int(self) > int(other)

        def __le__(self, other):
            Word.read += 1
            return int(self) <= int(other)

    a, b = [0], [0, 1]
    while len(b) < 8000:
        a, b = b, b + a
    for x in (b, [0] * 8000, [0, 0, 1, 0, 1, 1, 2] * 1100, ([0] * 50 + [1]) * 150):
        Word.read = 0
        periodic.lyndon_array([Word(v) for v in x])
        assert Word.read < 4 * len(x)


def test_values_are_equal_for_equal_words_only():
    words = "a b aa ab abcdefg abcdefgh abcdefgi abcdefgh é éééé a\x00 a\x00\x00 abcdefghijklmnopqrstuvwxyz".split(" ")
    import pyarrow as pa

    from spindrift.llm.words import text_bytes, word_bounds

    data, bounds = text_bytes(pa.array([" ".join(words)]))
    values = periodic.word_values(data, *word_bounds(data, bounds[:-1])).tolist()
    assert len(set(zip(words, values, strict=True))) == len(set(words)) == len(set(values))


@pytest.mark.parametrize(("least", "shortest"), [(4, 6), (2, 1)])
def test_odd_rows(odd, least, shortest):
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=str)
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(odd, least, shortest).collect()), key=lambda r: str((r[0], r[2])))
    want = []
    for i, text in rows:
        words = words_of(text)
        if len(words) > 3000:  # too long for all periods
            continue
        runs = runs_of(words, least, shortest)
        want.append((i, runs, collapsed(words, runs)))
    want.sort(key=lambda r: str((r[0], r[2])))
    assert [g for g in got if g[0] != 13] == want and len(got) == len(rows)


def test_query_on_documents(spark, sf_dir, documents):
    got = {r.doc_id: r for r in queries.op13_runs(spark, sf_dir).collect()}
    found = 0
    for d in documents.collect():
        words = planted(d.doc_id, words_of(d.text))
        if len(words) > 2500:
            continue
        runs = runs_of(words)
        best = None
        for s, n, q in runs:
            if best is None or n * best[2] > best[1] * q:
                best = (s, n, q)
        r, found = got[d.doc_id], found + bool(runs)
        text = collapsed(words, runs)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want
    assert len(got) == documents.count() and found > 5


def test_long_text_with_a_long_run(spark):
    text = " ".join([*(f"w{i % 700}" for i in range(60_000)), "end", *["a b"] * 30_000])
    (r,) = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in r.runs] == [(0, 60_000, 700), (60_001, 60_000, 2)] and len(r.collapsed.split()) == 703


def test_empty(empty):
    assert periodic.periodic_runs(empty).count() == 0
    assert periodic.with_planted_periods(empty).count() == 0
