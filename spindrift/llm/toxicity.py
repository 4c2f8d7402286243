"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding takes away disguises: compatibility forms and accents, letters of other scripts that look Latin, digits and symbols that stand for
letters, invisible characters. i, l and 1 fold to one letter, in the lexicon as in the text. Terms are whole words or
word stems. Matches inside an exception phrase do not count. The sum of the weights is set against
the text's length and mapped to a probability by a logistic curve.

Weights, stems, exceptions and the curve are learned from labelled rows, at most max_toxic and max_clean of them, taken in the order
of a hash of the id. A term must be precise on the sample; terms are chosen greedily by the toxic rows that they
explain and that no earlier term explains, so the words of a text that is copied many times do not enter
with it. Without labels the seed lexicon has to do, with DEFAULT_WEIGHT.

Defined cases: null or empty text has no match and gets the curve's lowest value; rows without an id are scored like any other;
labels that are null or repeated for an id count once; of repeated ids one text teaches; of terms that explain as many rows the shorter goes
first; texts are scored whole, whatever their length; extra columns stay as they are whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_arrow_batches, unit_hash

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕкмнтвԁԛԝһӏ" "αβεικνορτυχγω" "ıɑɡօսℓ",
        "aeopcyxijskmhtbdqwhi" "abeiknoptuxyw" "iagoui",
        strict=True,
    )
)
# Digits that stand for letters anywhere in a word, and symbols that do so next to letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SYMBOLS = {"!": "i", "|": "i", "$": "s", "@": "a", "€": "e"}
# The seed lexicon and phrases in which its words are harmless.
SEED_TERMS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "garbage human"]
SEED_EXCEPTIONS = ["trash can", "trash bin", "clown fish", "circus clown", "not stupid", "no idiot"]

DEFAULT_WEIGHT = 4.0
STEM_SIZES = (4, 5, 6, 7)

_TABLE = {ord(a): b for a, b in {**HOMOGLYPHS, **DIGITS, "l": "i"}.items()} | {c: None for c in [*range(0x300, 0x370), *range(0x200B, 0x2010), 0xAD, 0xFEFF]}
_SYMBOL = re.compile(r"(?<=\w)[!|$@€](?=\w)|(?<![\w!|$@€])[!|$@€](?=\w)")
_SPELLED = re.compile(r"\b(?:[^\W_][._*-]){2,}[^\W_]\b")
_BREAK = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Folded words parted, led and followed by single spaces."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    text = _SYMBOL.sub(lambda m: SYMBOLS[m[0]], text)
    text = _SPELLED.sub(lambda m: re.sub(r"[._*-]", "", m[0]), text)
    return f" {_BREAK.sub(' ', text.lower().translate(_TABLE)).strip()} "


@dataclass
class Lexicon:
    """terms: folded patterns, ' word ' or ' stem'; exceptions: folded phrases; curve: logistic coefficients."""

    terms: dict[str, float] = field(default_factory=lambda: {f" {fold(t).strip()}": DEFAULT_WEIGHT for t in SEED_TERMS})
    exceptions: list[str] = field(default_factory=lambda: [fold(t) for t in SEED_EXCEPTIONS])
    curve: tuple[float, ...] = (-3.0, 3.0, 0.6, 0.3)

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            if phrase not in self.terms:
                found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        return found


def matches(matcher, folded: str) -> list[tuple[int, int, float]]:
    """Spans and weights of terms in a folded text, outside of exceptions; of terms from one start the longest counts."""
    best, excused = {}, []
    for end, (n, weight) in matcher.iter(folded):
        start = end + 1 - n
        if weight is None:
            excused.append((start, end + 1))
        elif start not in best or best[start][0] < n:
            best[start] = (n, weight)
    found = [(s, s + n, w) for s, (n, w) in sorted(best.items())]
    return [x for x in found if not any(a <= x[0] and x[1] <= b + 1 for a, b in excused)] if excused else found


def features(hits: list[tuple[int, int, float]], words: int) -> tuple[float, float, float, float]:
    """What the curve sees: a constant, whether anything matched, the weights' sum, and the sum for each hundred words."""
    total = sum(w for *_, w in hits)
    return 1.0, float(bool(hits)), math.log1p(total), math.log1p(100 * total / (words + 100))


def logistic(x: np.ndarray, curve) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.asarray(curve), -30, 30)))


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's steps; coefficients of matches are kept from falling below zero."""
    beta = np.zeros(x.shape[1])
    shrink = ridge * np.r_[0.01, np.ones(x.shape[1] - 1)]
    for _ in range(40):
        p = logistic(x, beta)
        grad = x.T @ (weight * (p - y)) + shrink * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(shrink), grad)
        beta -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple([float(beta[0]), *np.maximum(beta[1:], 0).tolist()])


def training_mask(id_col: str = "doc_id"):
    """Rows that may teach: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 4000, max_clean: int = 8000, min_rows: int = 5, precision: float = 0.95) -> Lexicon:
    """A Lexicon from docs joined with labels. All that comes to the driver is bounded by the sample."""
    small_arrow_batches(docs.sparkSession)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("_toxic"))
    totals = dict(known.groupBy("_toxic").count().collect())
    if not totals.get(1) or not totals.get(0):
        return Lexicon()
    order = unit_hash(F.col("_id").cast("string"), seed=6)
    picked = known.filter("_toxic = 1").orderBy(order).limit(max_toxic).unionByName(known.filter("_toxic = 0").orderBy(order).limit(max_clean))
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(picked), "_id")
    # one text of each id, so the sample is as bounded as the ids
    rows = materialise(found.groupBy(F.col("_id").cast("long").alias("_id"), "_toxic").agg(F.min("_text").alias("_text")).select("_id", "_text", "_toxic"), "toxic-sample")

    def words(batches):
        for batch in batches:
            found = [sorted(set(fold(t).split())) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), batch.column(2)], ["_id", "_words", "_toxic"])

    bags = materialise(rows.mapInArrow(words, "_id long, _words array<string>, _toxic int"), "toxic-words")

    def stems(word):
        return F.array(F.concat(F.lit(" "), word, F.lit(" ")), *[F.when(F.length(word) >= n, F.concat(F.lit(" "), F.substring(word, 1, n))) for n in STEM_SIZES])

    each = F.array_distinct(F.flatten(F.transform("_words", stems)))
    terms = bags.select("_id", "_toxic", F.explode(each).alias("_term")).filter("_term is not null and length(_term) >= 5")
    share = totals[0] / max(1, min(totals[0], max_clean)), totals[1] / max(1, min(totals[1], max_toxic))
    marks = [F.bit_xor(F.xxhash64("_id", F.lit(n))).alias(f"_set{n}") for n in (0, 1)]
    often = terms.filter("_toxic = 1").groupBy("_term").agg(F.count(F.lit(1)).alias("_t"), *marks).filter(F.col("_t") >= min_rows)
    often = materialise(often, "toxic-often")  # terms of the toxic sample at most; only they are counted in clean rows
    clean = terms.filter("_toxic = 0").join(F.broadcast(often.select("_term")), "_term").groupBy("_term").agg(F.count(F.lit(1)).alias("_c"))
    counts = often.join(F.broadcast(clean), "_term", "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    good = counts.filter(F.col("_t") * share[1] >= precision * (F.col("_t") * share[1] + F.col("_c") * share[0]))
    # of terms of the same toxic rows the cover takes the first of the shortest: the others, as of copied texts, need not come
    good = good.groupBy("_set0", "_set1", "_t").agg(F.min(F.struct(F.length("_term").alias("_n"), "_term", "_c")).alias("_best")).select("_best._term", "_t", "_best._c")
    explained = terms.filter("_toxic = 1").join(F.broadcast(good), "_term").groupBy("_term", "_t", "_c").agg(F.collect_list("_id").alias("_ids")).toArrow()
    lexicon = Lexicon(terms=_cover(explained, min_rows, totals, share))
    lexicon.exceptions = _exceptions(rows, lexicon)
    return _calibrated(rows, lexicon, share)


def _cover(explained: pa.Table, min_rows: int, totals: dict, share: tuple[float, float]) -> dict[str, float]:
    """Terms chosen greedily by the rows that they alone explain; the shorter one of equals, so a stem before its words.

    explained: term, toxic rows, clean rows, ids of its toxic rows; sets of rows are bits of one number, max_toxic at most.
    """
    number: dict[int, int] = {}
    rows, stats = {}, {}
    for term, t, c, ids in zip(*[explained.column(i) for i in range(4)], strict=True):
        bits = 0
        for i in ids.as_py():
            bits |= 1 << number.setdefault(i, len(number))
        rows[term.as_py()], stats[term.as_py()] = bits, (t.as_py(), c.as_py())
    chosen, covered = {}, 0
    heap = sorted(rows, key=lambda t: (-rows[t].bit_count(), len(t), t))
    while heap:
        own = [(rows[t] & ~covered).bit_count() for t in heap]
        best = max(range(len(heap)), key=lambda i: (own[i], -len(heap[i])))
        term = heap[best]
        if own[best] < min_rows:
            break
        t, c = stats[term]
        odds = (t * share[1] + 0.5) / (totals[1] + 1) / ((c * share[0] + 0.5) / (totals[0] + 1))
        chosen[term] = round(max(1.0, math.log(odds)), 4)
        covered |= rows[term]
        heap = [x for x, n in zip(heap, own, strict=True) if x != term and n >= min_rows]
    for term in Lexicon().terms:
        if not any(term.startswith(x.rstrip()) and not x.endswith(" ") for x in chosen) and f"{term} " not in chosen:
            chosen.setdefault(term, DEFAULT_WEIGHT)
    return chosen


def _exceptions(rows: DataFrame, lexicon: Lexicon, least: int = 3) -> list[str]:
    """Pairs of a term's word and a neighbour that clean rows have, at least `least` of them, and toxic rows never."""

    def run(batches):
        matcher = lexicon.matcher()
        for batch in batches:
            seen = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded, pairs = fold(text), set()
                for start, end, _ in matches(matcher, folded):
                    close = folded.find(" ", max(end - 1, start + 1))
                    word = folded[start:close]
                    before, after = folded[:start].rsplit(" ", 1)[-1], folded[close + 1 :].split(" ", 1)[0]
                    pairs |= {f" {before}{word} "} if before else set()
                    pairs |= {f"{word} {after} "} if after else set()
                seen += [(p, toxic) for p in sorted(pairs)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.int32())], ["_pair", "_toxic"])

    pairs = rows.select(F.col("_text").cast("string"), "_toxic").mapInArrow(run, "_pair string, _toxic int")
    kept = pairs.groupBy("_pair").agg(F.sum("_toxic").alias("_t"), F.sum(1 - F.col("_toxic")).alias("_c")).filter((F.col("_t") == 0) & (F.col("_c") >= least))
    return sorted({*Lexicon().exceptions, *(r[0] for r in kept.select("_pair").collect())})


def _calibrated(rows: DataFrame, lexicon: Lexicon, share: tuple[float, float]) -> Lexicon:
    """The curve from the counts of equal feature rows, rounded, so that few come to the driver."""
    seen = _scored(rows.select("_id", "_text", "_toxic"), lexicon, "_toxic").groupBy(F.round("_any", 2), F.round("_sum", 2), F.round("_rate", 2), "_toxic").count().collect()
    x = np.array([[1.0, *r[:3]] for r in seen])
    y = np.array([r[3] for r in seen], float)
    weight = np.array([r[4] * share[r[3]] for r in seen], float)
    return Lexicon(lexicon.terms, lexicon.exceptions, _fit_curve(x, y, weight / weight.sum() * sum(r[4] for r in seen)))


def _scored(rows: DataFrame, lexicon: Lexicon, more: str) -> DataFrame:
    """rows (_id, _text, more) with their features and the number of matches."""

    def run(batches):
        matcher = lexicon.matcher()
        for batch in batches:
            made = []
            for text in batch.column(1).to_pylist():
                folded = fold(text)
                hits = matches(matcher, folded)
                made.append((*features(hits, folded.count(" ") - 1)[1:], len(hits)))
            columns = list(zip(*made, strict=True)) if made else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, k) for c, k in zip(columns, [pa.float64()] * 3 + [pa.int64()], strict=True)]], ["_id", more, "_any", "_sum", "_rate", "_hits"])

    return rows.select(F.col("_id").cast("long"), F.col("_text").cast("string"), F.col(more).cast("int")).mapInArrow(run, f"_id long, {more} int, _any double, _sum double, _rate double, _hits long")


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and n_matches of every row of docs."""
    small_arrow_batches(docs.sparkSession)
    b = lexicon.curve
    found = _scored(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.lit(0).alias("_more")), lexicon, "_more")
    logit = F.lit(b[0]) + b[1] * F.col("_any") + b[2] * F.col("_sum") + b[3] * F.col("_rate")
    return found.select(F.col("_id").alias(id_col), (1 / (1 + F.exp(-logit))).alias("score"), F.col("_hits").alias("n_matches"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below threshold, with their columns."""
    small_arrow_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        matcher = lexicon.matcher()
        for batch in batches:
            folded = [fold(t) for t in batch.column(at).to_pylist()]
            x = np.array([features(matches(matcher, f), f.count(" ") - 1) for f in folded]).reshape(-1, 4)
            yield batch.filter(pa.array(logistic(x, lexicon.curve) < threshold))

    return docs.mapInArrow(run, docs.schema)
