import random

import pytest

CLASHING = "kept size score length count copies piece start offset _id _id2 _sha _n _block _words _suspect _text _row _size _source _key _class _cell _z _copies _mix_n _mix_id _group _rest _seed _pos _oid _at _page _payload _refers _spans _uid _token _rep _c _f _lo _hi runs collapsed word n form root component_id _bands _set _rows _w _side _i _a _p _g best".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "x"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, near copies, a hot group."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, base, "en", "a", 1), (1, base, "en", "a", 1), (2, " ".join(near), "en", "b", 1), (3, "", "en", "b", 0), (4, None, "en", None, None), (5, " \t\n\x0b\x0c\r ", None, "c", 7),
        (6, base.replace(" ", "\n"), "en", "c", 1), (6, base.replace(" ", "\n"), "en", "c", 1), (None, prose(2, 80), "de", "d", 1), (None, None, None, None, None),
        (8, "one", "en", "a", 3), (9, "ONE", "en", "a", 3), (10, "one two three four", "en", "a", 3), (11, "é" * 300, "fr", "é", 300), (12, "x" * 30_000, "en", "a", 1), (13, prose(3, 9000), "en", "a", 1),
        (14, "words " + base + " after it all", "en", "b", 1), (15, "日本語 テキスト   nbsp em", "ja", "z", 5), (16, "a\x00b", "en", "a", 3), (17, "😀 " * 200, "en", "e", 400),
    ]
    hot = prose(4, 60)
    rows += [(100 + i, hot, "en", "hot", 1) for i in range(40)]
    rows += [(200 + i, prose(4, 60) + f" tail{i}", "en", "hot", 1) for i in range(30)]
    rows += [(300 + i, prose(50 + i, 20 + 7 * i), "de", f"s{i % 3}", 1) for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names clash with those that operators add."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.withColumns({c: F.lit("extra") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
