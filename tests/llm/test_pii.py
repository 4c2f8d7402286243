import hashlib
import re

from spindrift.llm import pii

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


HARD = [
    "a@b.c_d@e.f", "a@b.c@d.e.f", "x..y%+-@a-b.c", "@a.b a@b a@b.", "a@b.c.d.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4", "001.002.000255.4", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111-1", "41111111 11111111 4111111111111111",
    "5--4111111111111111", "4111  1111 4111111111111111", "+1 (274) 555-9629", "+1 (274) 555-9629 4111111111111111", "++123456789", "+1-", "+12.34.56.78.90 x", "😀 a@b.c é 1.2.3.4", "9" * 40, "+1" + " " * 50 + "23456789", None, "",
    "4" * 50_000, "a" * 200_000 + "@", "1." * 30_000, "+1" + "(" * 50_000, "a.b@" * 5_000,
]


def digest(df):
    from pyspark.sql import functions as F

    return {r[0]: (r[1], r[2]) for r in pii.find_pii(df).select("doc_id", pii.span_list(F.col("base")), pii.span_list(F.col("spans"))).collect()}


def test_base_patterns_are_those_of_the_contract(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = digest(df)
    for i, text in enumerate(HARD):
        assert got[i][0] == brute(text), text and text[:60]


def test_documents_and_added_spans(spark, documents):
    got = digest(documents)
    for r in documents.collect():
        base, spans = got[r.doc_id]
        assert base == brute(r.text)
        assert hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(spans.split(",")) | {""}


def test_many_matches_in_one_text_take_linear_time(spark):
    import time

    rows = [(0, "".join(f"user{i}a@mail{i % 7}.example.org key x9{i:06d}abcdef12 10.0.0.{i % 256} " for i in range(20_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    begin = time.time()
    base, spans = digest(df)[0]
    assert time.time() - begin < 100
    assert base == brute(rows[0][1]) and base.count("email") == base.count("ip") == 20_000 and len(spans) >= len(base)


def test_candidates_apart_from_base_spans(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    for size in (0, 3, 300):
        spans = lambda n: sorted((s := r.randrange(2000), s + r.randrange(1, 9)) for _ in range(n))
        base, loose = spans(size), spans(size)
        df = spark.createDataFrame([(base, loose)], "base array<struct<start:int,end:int>>, loose array<struct<start:int,end:int>>")
        got = df.select(pii._apart(F.col("loose"), F.col("base")).alias("x")).first().x
        assert [tuple(s) for s in got] == [c for c in loose if not any(b[0] < c[1] and c[0] < b[1] for b in base)]


def test_secrets_are_added_and_prose_is_not(spark):
    lines = [f"say password=da3fe1{i:04d}3e135f8 now" for i in range(20)] + [f'set token = "0641917ea4e9feb9cda83477b57ac2654884{i:04d}"' for i in range(20)] + [f"key AKIAMD62HKU6VBLC{i:04d} end" for i in range(10, 30)]
    prose = [f"the well-known-model-number{i} of version2release" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(lines + prose)), "doc_id long, text string")
    got = digest(df)
    found = [i for i, (_, spans) in got.items() if "secret" in spans]
    assert sorted(found) == list(range(len(lines)))


def test_odd_rows(odd, empty):
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(empty).count() == 0


def test_em_recovers_reliabilities():
    import itertools

    accuracy, share, counts = [0.9, 0.8, 0.85, 0.75, 0.7], 0.4, []
    for pattern in itertools.product((0, 1), repeat=5):
        p = share
        q = 1 - share
        for a, v in zip(accuracy, pattern, strict=True):
            p *= a if v else 1 - a
            q *= 1 - a if v else a
        counts.append((pattern, round(1e6 * (p + q))))
    prior, rates, posterior = pii.expectation_maximisation(counts, rounds=400)
    assert abs(prior - share) < 0.03 and all(abs(r[0][1] - a) < 0.03 for r, a in zip(rates, accuracy, strict=True))
    assert posterior[1, 1, 1, 1, 1] > 0.99 > 0.01 > posterior[0, 0, 0, 0, 0]
