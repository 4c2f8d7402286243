import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spindrift.llm.packing import WordTokenizer, _sweep, pack_documents, plan_rounds

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(df, capacity):
    whole = Tokenizer.from_file(PATH)
    want = []
    for r in df.collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(str(r.doc_id), p, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for p, s in enumerate(range(0, len(ids), capacity))]
    got = pack_documents(df, PATH, capacity).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    room = {}
    for r in got:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in room.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in got) // capacity)
    return len(room), least


def test_odd_rows(odd):
    check(odd, 256)


def test_special_tokens_in_text(spark):
    rows = [(0, "a <|endoftext|> b<|startoftext|>c it's WE'LL don't x\x1cy é"), (1, None)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 2048)


def test_documents_fill_sequences(documents):
    used, least = check(documents, 2048)
    assert used <= least * 1.02 + 1


@pytest.mark.parametrize("capacity,make", [(2048, lambda r: min(2048, int(r.lognormvariate(5.5, 1.2)) + 1)), (64, lambda r: r.choice([1, 1, 1, 1, 2, 3, 64])), (100, lambda r: 51)])
def test_plan_places_all_and_is_near_the_lower_bound(spark, capacity, make):
    r = random.Random(3)
    counts = {}
    for _ in range(20_000):
        n = make(r)
        counts[n] = counts.get(n, 0) + 1
    plan = plan_rounds(spark.createDataFrame(sorted(counts.items()), "length long, n long"), capacity).collect()
    ranks, filled = {}, {}
    for p in plan:
        ranks.setdefault(p.length, []).extend(range(p.rank, p.rank + p.n * p.unit))
        for s in range(p.first, p.first + p.n):
            filled.setdefault(s, []).append((p.offset, p.length * p.unit))
    assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    assert len(filled) <= (20_000 if capacity == 100 else 1.005 * least + 1)


def test_a_round_is_best_fit(spark):
    """Against the plain form: documents in order, longest first, each into the smallest gap that holds it."""
    r = random.Random(5)
    for _ in range(2):
        docs = {r.randint(1, 200): r.randint(1, 9) for _ in range(30)}
        gaps = {r.randint(1, 200): r.randint(1, 9) for _ in range(25)}
        first, rows = 0, []
        for g, n in gaps.items():
            rows.append((g, first, n))
            first += n
        free, want = sorted(g for g, n in gaps.items() for _ in range(n)), []
        for length in sorted((n for n, c in docs.items() for _ in range(c)), reverse=True):
            fit = next((i for i, g in enumerate(free) if g >= length), None)
            if fit is not None:
                want.append((length, free.pop(fit)))
        moves = _sweep(spark.createDataFrame([(n, 0, c) for n, c in docs.items()], "length long, rank long, n long"), spark.createDataFrame(rows, "size long, rank long, n long"), 1, 200, 200, 55).collect()
        got = [(m.length, 200 - m.offset) for m in moves if m.what == "placed" for _ in range(m.n)]
        assert sorted(got) == sorted(want)
        assert sorted(m["size"] for m in moves if m.what == "gaps" for _ in range(m.n)) == free
        assert sum(m.n for m in moves if m.what == "docs") == sum(docs.values()) - len(want)


def test_pieces_of_any_script(spark):
    r = random.Random(7)
    signs = "aB1.,é-Ω ñ中ß\t\n!?\"'_x  <|>&@\x1c\u0301Ḧ"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["<|ENDOFTEXT|>", "a<|endoftext|>B", "H\u0331 h\u0331"]
    tokens, whole = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    ids, bounds = tokens(pa.array([*texts, None], pa.string()))
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert whole.encode(t, add_special_tokens=False).ids == ids[a:b].tolist(), t


def test_empty(empty):
    assert pack_documents(empty, PATH).count() == 0
