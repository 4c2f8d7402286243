"""The corpus pipeline: each stage against a plain form of it on the same rows, the whole from end to end."""

import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from spindrift.llm import mixing, queries, stages, toxicity
from spindrift.llm.common import materialise

from .test_exact_dedup import brute as exact_groups
from .test_jaccard import brute as near_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def fixed(spark, sf_dir):
    """The lexicon that the stage learns, so that the stage and the plain form share it."""
    return queries.fitted_lexicon(spark, sf_dir, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def plain_score(text, lexicon):
    """The score without Aho-Corasick: each term is searched for at each place."""
    folded, best, excused = toxicity.fold(text), {}, []
    for at in range(len(folded)):
        fits = [t for t in lexicon.terms if folded.startswith(t, at)]
        if fits:
            best[at] = max(fits, key=len)
        excused += [(at, at + len(p)) for p in lexicon.exceptions if p not in lexicon.terms and folded.startswith(p, at)]
    hits = [(s, s + len(t), lexicon.terms[t]) for s, t in sorted(best.items()) if not any(a <= s and s + len(t) <= b + 1 for a, b in excused)]
    return float(toxicity.logistic(toxicity.np.array([toxicity.features(hits, folded.count(" ") - 1)]), lexicon.curve)[0])


def test_stages_against_plain_forms(spark, sf_dir, fixed):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(materialise(stage(spark, steps[-1], sf_dir), f"test-{name}"))
        assert name == "packing" or steps[-1].columns == docs.columns
    rows = [[tuple(r) for r in s.collect()] for s in steps]
    at = docs.columns.index("text")
    assert sorted(rows[1], key=str) == sorted((r for r in rows[0] if plain_score(r[at], fixed) < queries.TOXIC_AT), key=str)
    want, _ = exact_groups([(r[0], r[at]) for r in rows[1]])
    assert sorted(r[0] for r in rows[2]) == sorted({keep for _, keep, _, _ in want})
    near = near_groups([(r[0], r[at]) for r in rows[2]])
    assert sorted(r[0] for r in rows[3]) == sorted(i for i, (_, first) in near.items() if i == first)
    copies = {r.doc_id: r.copies for r in mixing.mix(steps[3]).collect()}
    assert Counter(r[0] for r in rows[4]) == Counter({i: int(n) for i, n in copies.items() if n})
    placed = defaultdict(list)
    for r in steps[5].collect():
        placed[r.sequence_id].append((r.offset, r.length))
    assert Counter(r.doc_id for r in steps[5].filter("piece = 0").collect()) == Counter(r[0] for r in rows[4])
    for parts in placed.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= queries.CAPACITY


def test_stages_on_odd_rows(spark, sf_dir, odd, empty, fixed, monkeypatch):
    monkeypatch.setattr(stages, "fitted_lexicon", lambda *_: fixed)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns, name
        kept = {tuple(r) for r in odd.collect()}
        assert out.count() and {tuple(r) for r in out.collect()} <= kept, name
        assert stage(spark, empty, sf_dir).count() == 0, name
    assert stages.pack(spark, odd, sf_dir).filter("piece = 0").count() == odd.count()


def test_run_gives_what_the_stages_give(spark, sf_dir):
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count()


def test_scores_equal_a_direct_search(spark, fixed):
    r = random.Random(2)
    pool = [t.strip() for t in fixed.terms] + [w for p in fixed.exceptions for w in p.split()] + "plain words of no harm 1d1ot tr@sh can".split()
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randrange(30)))) for i in range(150)] + [(200, None), (201, "")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), fixed).collect()
    for x in got:
        assert abs(x.score - plain_score(dict(rows)[x.doc_id], fixed)) < 1e-9


def test_held_out_rows_do_not_teach(spark, sf_dir):
    ids = [r.doc_id for r in spark.range(200).select(F.col("id").alias("doc_id")).filter(~toxicity.training_mask()).collect()]
    assert ids == [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
