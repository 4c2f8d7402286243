import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from spindrift.llm import queries, spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def thinned_counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 7
    return {w: c for w, c in n.items() if c >= 2}


def brute(n):
    """Every pair of words that share one of all their strings with a letter left out, compared directly."""
    by = defaultdict(set)
    for w in n:
        for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by[x].add(w)
    found = {}
    for w in n:
        others = set().union(*(by[x] for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}))
        close = [o for o in others if near(w, o)]
        best = min(close, key=lambda o: (-n[o], o), default=None)
        found[w] = (best if close and n[best] >= 10 * n[w] else None, len(close))
    out = {}
    for w, (form, count) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out[w] = (form, root, n[w], count, n[form] if form else None)
    return out


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_on_documents(spark, sf_dir, documents):
    want = brute(thinned_counts([(r.doc_id, r.text) for r in documents.collect()]))
    got = queries.op12_spelling(spark, sf_dir)
    assert rows_of(got) == want and got.count() == len(want) and any(v[0] for v in want.values())


def test_odd_rows(odd):
    rows = [("null" if r.doc_id is None else r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(spelling.spelling_variants(odd, change=spelling.thinned)) == brute(thinned_counts(rows))


def word_rows(seed, letters, sizes, n):
    r, words = random.Random(seed), {}
    for _ in range(n):
        w = "".join(r.choice(letters) for _ in range(r.randrange(*sizes)))
        words[w] = r.choice([2, 5, 30, 400, 9000])
        for _ in range(r.randrange(3)):
            k = r.randrange(len(w))
            w = w[:k] + r.choice(["", r.choice(letters), w[k] + r.choice(letters)]) + w[k + 1 :]
            if len(w) >= 7:
                words[w] = r.choice([2, 5, 30, 400, 9000])
    return words


@pytest.mark.parametrize(("letters", "sizes", "piece"), [("ab", (7, 11), 100_000), ("ab", (7, 12), 40), ("abcdeéÿ", (7, 25), 100_000), ("abc", (300, 400), 7)])
def test_words_of_few_letters(spark, letters, sizes, piece):
    """Halves that very many words share, one key for a third of all words, keys cut into a grid of pieces and blocks, long words."""
    words = word_rows(5, letters, sizes, 250)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.variants(df, piece=piece)) == brute(words)


def test_chains_of_forms(spark):
    words = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000, "zbcdefg": 3}
    got = rows_of(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute(words) and got["abcdefg"][1] == "abcdefghijk"


def test_candidates_do_not_grow_with_the_square_of_a_half():
    """500 words with one left half and ends of their own give a few candidates each, not 500."""
    r = random.Random(1)
    words = sorted({"inter" + "".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(500)})
    seen = []
    common = spelling.common
    try:
        spelling.common = lambda a, i, *rest: (seen.append(len(i)), common(a, i, *rest))[1]
        spelling.near_pairs([w.encode() for w in words], [w.encode() for w in words], 0)
    finally:
        spelling.common = common
    assert max(seen) < 10 * len(words)


def test_empty(empty):
    assert spelling.spelling_variants(empty).count() == 0
