"""Personal data by weak supervision, in DataFrame expressions alone.

Four base patterns (e-mail, IPv4 address, payment card, phone) are certain by contract. Further candidates come from loose patterns: tokens
that look like keys or passwords, national phone numbers, spelled-out e-mail addresses. On each candidate five labelers vote
yes, no or nothing: the shape of the token (regular expressions), words that announce such data (a gazetteer), the marks around
it (context), the mixture of its characters, and its likeness to prose. Expectation-maximisation over the counts of
vote patterns estimates each labeler's reliability; the patterns' posteriors then train the span classifier, a naive
Bayes model over features of the span and its surroundings, which decides. What comes to the driver is bounded by the
number of vote patterns and feature values, not by the corpus.

Positions are code points, found by splitting a text at its matches. The patterns are written with look-behinds and possessive
repeats so that they find just what the plain base patterns find, in linear time on any text.

Defined cases: null text is empty; an empty text has no spans; null ids stay null; repeated rows give repeated results; without candidates
nothing is trained and base spans alone are returned; candidates that overlap a base span are left to it;
spans of one start stand in the order of their kinds; whole texts are searched, in time linear in their length and matches; columns other
than id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# Kinds of spans in their order, the base ones first.
KINDS = ["email", "ip", "card", "phone", "secret"]
# The base patterns, made linear: they start at the head of a run (or where the last match ended) and never give back.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must have for a pattern to be worth trying.
HINT = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
LOOSE = {
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]*[0-9])(?=[A-Za-z0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{12,}+",
    "phone": r"(?<![0-9+.(\x20-])(?<![0-9]\x20)(?:\x20)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63})+",
}
LOOSE_HINT = {"secret": "[0-9]", "phone": "[0-9]{3}[.-][0-9]{4}", "email": r"[\[(]at[\])]"}
# Words that announce credentials or contact data, in the languages of the corpus.
GAZETTEER = r"(?i)(?:password|passwd|passwort|pwd|token|secret|api[_ -]?key|access[_ -]?key|credential|bearer|contraseña|clave|mot de passe|jeton|kennwort|schlüssel|phone|tel|call|mobile|fax|mail|contact|kontakt)\W{0,6}$"
KEY_SHAPE = r"^(?:AKIA[A-Z0-9]{16}|[0-9a-f]{16,}|[0-9A-F]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{16,}|[A-Za-z0-9+/]{32,})$"
OPENS, CLOSES = r"[=:\"'(<\[]\s?$", r"^[\"')>\]]"
LABELERS = ["shape", "gazetteer", "context", "mixture", "prose"]
CONTEXT = 40
BLOCK = 128
FAR = 2**31 - 1


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once: inside of a lambda a plain expression would be evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, combine, zero: int) -> Column:
    """For each of values what combine makes of zero and all values before it, and at last of all.

    In blocks, since an array is copied when it grows: the blocks' own running values first, then those over the blocks.
    """

    def fold(items: Column, last) -> Column:
        return F.aggregate(items, F.array(F.lit(zero)), lambda out, x: F.concat(out, F.array(combine(F.element_at(out, -1), last(x)))))

    def over(own: Column, whole: Column) -> Column:
        parts = F.transform(own, lambda block, b: F.transform(F.slice(block, 1, F.size(block) - 1), lambda x: combine(F.get(whole, b), x)))
        return F.concat(F.flatten(parts), F.array(F.element_at(whole, -1)))

    def walk(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
        own = F.transform(blocks, lambda block: fold(block, lambda x: x))
        return _let(own, lambda own: _let(fold(own, lambda block: F.element_at(block, -1)), lambda whole: over(own, whole)))

    return _let(values, walk)


def _spans(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<start, end, match, before, after>> of the matches in a text; positions follow from the lengths of the pieces between."""
    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")

    def located(v: Column) -> Column:
        parts, found = v["parts"], v["found"]
        steps = F.transform(found, lambda m, i: F.length(F.get(parts, i)) + F.length(m))
        return _let(steps, lambda steps: _let(_running(steps, lambda x, y: x + y, 0), lambda ends: F.transform(found, lambda m, i: F.struct((F.get(ends, i + 1) - F.length(m)).alias("start"), F.get(ends, i + 1).alias("end"), m.alias("match"), F.right(F.get(parts, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(parts, i + 1), F.lit(4)).alias("after")))))

    pieces = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(hint) & text.rlike(pattern), _let(pieces, located)).otherwise(none)


def _apart(loose: Column, base: Column) -> Column:
    """loose spans that no base span overlaps. Both in order of start, an earlier base span overlaps if the largest end so far is beyond the start, a later one if the next start is before the end."""
    marks = F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("at"), F.lit(0).alias("loose"), s["end"].alias("end"), F.lit(0).alias("i"))), F.transform(loose, lambda s, i: F.struct(s["start"].alias("at"), F.lit(1).alias("loose"), s["end"].alias("end"), i.alias("i"))))

    def largest(x, y):
        return F.greatest(x, y)

    def clear(marks: Column) -> Column:
        before = _running(F.transform(marks, lambda m: F.when(m["loose"] == 0, m["end"]).otherwise(-1)), largest, -1)
        after = F.reverse(_running(F.reverse(F.transform(marks, lambda m: F.when(m["loose"] == 0, -m["at"]).otherwise(-FAR))), largest, -FAR))
        both = F.struct(before.alias("before"), after.alias("after"))
        free = lambda v: F.filter(marks, lambda m, k: (m["loose"] == 1) & (F.get(v["before"], k) <= m["at"]) & (-F.get(v["after"], k + 1) >= m["end"]))
        return _let(both, lambda v: F.transform(F.array_sort(F.transform(free(v), lambda m: m["i"])), lambda i: F.get(loose, i)))

    return F.when((F.size(base) == 0) | (F.size(loose) == 0), loose).otherwise(_let(F.array_sort(marks), clear))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"))
    n = F.length(_digits(match))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(match))).otherwise(False)
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match"), s["before"].alias("before"), s["after"].alias("after")))


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base (certain spans) and loose (candidates), arrays of spans in order of (start, kind), written to the shared folder."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), text.alias("_text"))
    for kind, pattern in BASE.items():
        found = _spans(F.col("_text"), pattern, HINT[kind])
        rows = rows.withColumn(f"_{kind}", _tagged(F.filter(found, lambda s: _valid(kind, s["match"])), kind))
    for kind, pattern in LOOSE.items():
        rows = rows.withColumn(f"_loose_{kind}", _tagged(_spans(F.col("_text"), pattern, LOOSE_HINT[kind]), kind))
    base = F.array_sort(F.concat(*[F.col(f"_{k}") for k in BASE]))
    loose = F.array_sort(F.concat(*[F.col(f"_loose_{k}") for k in LOOSE]))
    rows = rows.select(id_col, base.alias("base"), loose.alias("loose"))
    apart = _let(F.struct("loose", "base"), lambda v: _apart(v["loose"], v["base"]))
    slim = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match")))
    return materialise(rows.select(id_col, slim.alias("base"), apart.alias("loose")), "pii-spans")


def votes(span: Column) -> list[Column]:
    """The labelers' votes on a candidate: 1 yes, 0 no, 2 nothing."""
    match, before, after, kind = span["match"], span["before"], span["after"], span["kind"]
    secret = kind == "secret"
    digits = F.length(_digits(match)) / F.length(match)
    yes, no, none = F.lit(1), F.lit(0), F.lit(2)
    return [
        F.when(secret, F.when(match.rlike(KEY_SHAPE), yes).otherwise(no)).otherwise(F.when(match.rlike(r"[0-9]{3}[.-][0-9]{4}$|@|at"), yes).otherwise(none)),
        F.when(before.rlike(GAZETTEER), yes).otherwise(none),
        F.when(before.rlike(OPENS) | after.rlike(CLOSES), yes).when(secret & before.rlike(r"[A-Za-z0-9]$"), no).otherwise(none),
        F.when(secret, F.when((digits >= 0.1) & match.rlike(r"[A-Za-z][0-9].*[0-9][A-Za-z]|[0-9][A-Za-z].*[A-Za-z][0-9]"), yes).otherwise(no)).otherwise(none),
        F.when(match.rlike(r"[a-z]{7,}|-[a-z]+-"), no).otherwise(none),
    ]


def features(span: Column) -> dict[str, Column]:
    """What the classifier sees of a candidate, as small categories."""
    match, before, after = span["match"], span["before"], span["after"]
    n = F.length(match)
    return {
        "length": F.when(n < 14, "s").when(n < 18, "m").when(n < 24, "l").otherwise("x"),
        "digits": F.floor(F.length(_digits(match)) / n * 4).cast("string"),
        "case": F.when(match.rlike("[a-z]") & match.rlike("[A-Z]"), "both").when(match.rlike("[A-Z]"), "upper").otherwise("lower"),
        "charset": F.when(match.rlike("^[0-9a-fA-F]+$"), "hex").when(match.rlike("^[A-Za-z0-9]+$"), "plain").otherwise("marks"),
        "run": F.when(match.rlike("[A-Za-z]{7}"), "word").otherwise("none"),
        "before": F.when(before.rlike(GAZETTEER), "cue").when(before.rlike(OPENS), "open").when(before.rlike(r"\s$"), "space").otherwise("other"),
        "after": F.when(after.rlike(CLOSES), "close").otherwise("other"),
    }


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, prior: float = 0.3) -> tuple[float, list, dict]:
    """Share of true spans, each labeler's vote rates given truth, and each pattern's posterior, from counts of vote patterns.

    Starts from labelers that are right more often than not; rates are smoothed by one vote each.
    """
    rates = [([0.2, 0.7, 0.1], [0.6, 0.2, 0.2]) for _ in LABELERS]  # given a true span, given a false one; votes no, yes, none
    posterior: dict[tuple[int, ...], float] = {}
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        for pattern, _ in patterns:
            logit = math.log(prior / (1 - prior)) + sum(math.log(r[0][v] / r[1][v]) for r, v in zip(rates, pattern, strict=True))
            posterior[pattern] = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
        true = sum(n * posterior[p] for p, n in patterns)
        prior = min(0.999, max(0.001, (true + 1) / (total + 2)))
        rates = [
            tuple([(sum(n * w(posterior[p]) for p, n in patterns if p[k] == vote) + 1) / (mass + 3) for vote in range(3)] for w, mass in ((lambda q: q, true), (lambda q: 1 - q, total - true)))
            for k in range(len(LABELERS))
        ]
    return prior, rates, posterior


class SpanClassifier:
    """Naive Bayes over categories: for each kind a bias and a weight for each feature value."""

    def __init__(self, bias: dict[str, float], weights: dict[str, float]):
        self.bias, self.weights = bias, weights

    def probability(self, span: Column) -> Column:
        def look(table: dict[str, float], key: Column) -> Column:
            if not table:
                return F.lit(0.0)
            return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(0.0))

        logit = look(self.bias, span["kind"])
        for name, value in features(span).items():
            own = {k: w for k, w in self.weights.items() if k.split("|")[1] == name}
            logit = logit + look(own, F.concat_ws("|", span["kind"], F.lit(name), value))
        return 1 / (1 + F.exp(-logit))


def train(candidates: DataFrame) -> SpanClassifier | None:
    """The classifier learned from the votes on all candidates; None where there are none."""
    each = candidates.filter(F.size("loose") > 0).select(F.explode("loose").alias("s"))
    pattern = F.concat_ws("", *[x.cast("string") for x in votes(F.col("s"))])
    counted = each.groupBy(F.col("s.kind").alias("kind"), pattern.alias("p")).count().collect()  # 3 ** 5 patterns of each kind at most
    if not counted:
        return None
    posterior, bias = {}, {}
    for kind in sorted({r["kind"] for r in counted}):
        share, _, found = expectation_maximisation([(tuple(map(int, r["p"])), r["count"]) for r in counted if r["kind"] == kind])
        posterior |= {f"{kind}|{''.join(map(str, p))}": q for p, q in found.items()}
        bias[kind] = math.log(share / (1 - share))
    table = F.create_map(*[F.lit(x) for kv in posterior.items() for x in kv])
    seen = [F.concat_ws("|", F.col("s.kind"), F.lit(n), c) for n, c in features(F.col("s")).items()]
    soft = each.select(F.element_at(table, F.concat_ws("|", F.col("s.kind"), pattern)).alias("q"), F.explode(F.array(*seen)).alias("v"))
    sums = soft.groupBy("v").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).collect()  # one row for each feature value
    totals: dict[str, list[float]] = {}
    for r in sums:
        t = totals.setdefault("|".join(r["v"].split("|")[:2]), [0.0, 0.0, 0.0])
        totals["|".join(r["v"].split("|")[:2])] = [t[0] + r["yes"], t[1] + r["no"], t[2] + 1]
    weights = {}
    for r in sums:
        yes, no, values = totals["|".join(r["v"].split("|")[:2])]
        weights[r["v"]] = math.log((r["yes"] + 0.5) / (yes + 0.5 * values) / ((r["no"] + 0.5) / (no + 0.5 * values)))
    return SpanClassifier(bias, weights)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, base and spans: arrays of structs (start, rank, end, kind, match); spans holds base and what the classifier adds."""
    found = find_candidates(docs, id_col, text_col)
    model = train(found)
    if model is None:
        return found.select(id_col, "base", F.col("base").alias("spans"))
    added = F.transform(F.filter("loose", lambda s: model.probability(s) >= threshold), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match")))
    return found.select(id_col, "base", F.array_sort(F.concat("base", F.when(F.size("loose") > 0, added).otherwise(F.slice("base", 1, 0)))).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
