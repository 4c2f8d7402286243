import random

import pytest
from pyspark.sql import functions as F

from spindrift.llm import toxicity as t

from .conftest import WORDS


def test_folding_takes_disguises_away():
    plain = t.fold("you idiot loser")
    for text in ("you 1d1ot l0ser", "YOU ІDІОТ LOSER", "you i.d.i.o.t l-o-s-e-r", "yöu ïdïót lösér", "you id​iot loser", "you !diot lo$er"):
        assert t.fold(text) == plain
    assert t.fold(None) == t.fold("") == t.fold(" ,. ") == "  " or t.fold(None) == " "


def test_exceptions_and_longest_terms():
    lexicon = t.Lexicon({" trash": 2.0, t.fold("trashy"): 3.0}, [t.fold("trash can")])
    hits = lambda s: [w for *_, w in t.matches(lexicon.matcher(), t.fold(s))]
    assert hits("the trash can is full") == [] and hits("trash and trashy") == [2.0, 3.0] and hits("a trash can of trash") == [2.0]


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(WORDS) + r.choice(["", "a", "b"]) for _ in range(r.randrange(20, 200))]
        toxic = i % 9 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(["grumpfel", "grumpfen", "grуmpfig", "idiot"])
        elif i % 10 == 1:
            words += ["no", "idiot"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic) if i % 50 else None))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_stems_and_scores_held_out(labelled):
    docs, labels = labelled
    lexicon = t.learn(docs, labels.filter(t.training_mask()))
    assert any(x.startswith(" grum") and not x.endswith(" ") for x in lexicon.terms)
    rows = t.score(docs, lexicon).join(labels, "doc_id").filter(~t.training_mask() & F.col("toxic").isNotNull()).collect()
    assert rows and all((r.score >= 0.7) == (r.toxic == 1) for r in rows)


def test_held_out_accuracy_on_test_table(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = t.score(docs, t.learn(docs, labels.filter(t.training_mask()))).join(labels, "doc_id").filter(~t.training_mask()).collect()
    right = sum((r.score >= 0.7) == (r.toxic == 1) for r in rows)
    assert right / len(rows) > 0.93 and not any(r.score >= 0.7 and r.toxic == 0 for r in rows)


def test_odd_rows_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = t.learn(odd, none)
    got = t.score(odd, lexicon).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    kept = t.drop_toxic(odd, lexicon)
    assert kept.columns == odd.columns and kept.count() == sum(r.score < 0.7 for r in got)
    assert t.score(empty, lexicon).count() == 0 and t.drop_toxic(empty, lexicon).count() == 0


def test_copies_of_a_text_of_many_words_do_not_crowd_out_rarer_terms(spark):
    import itertools

    words = ["".join(w) for w in itertools.islice(itertools.product("bcdfg", "aeiou", "klmnp", "aeiou", "rstvz"), 0, None, 4)]
    copied = " ".join(f"{w}{w[::-1]}" for w in words)
    rows = [(i, copied, 1) for i in range(30)] + [(100 + i, f"some plain lines with zorgblat in row {i}", 1) for i in range(8)] + [(1000 + i, f"some plain lines with nothing in row {i}", 0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = t.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert any(" zorgblat ".startswith(x) for x in lexicon.terms), lexicon.terms
