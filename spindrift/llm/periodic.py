"""Periodic runs of words by Lyndon arrays.

A run is a stretch of consecutive words that repeats with smallest period q and that no neighbouring word extends. Each run of an exponent
of 2 or more starts one of its periods with a Lyndon root: the longest Lyndon word at its place, by the order of words or by the
reverse order. So both Lyndon arrays of a text, and how far each longest Lyndon word is repeated behind it, give all runs.

* A Lyndon array is the next smaller suffix of each place. One pass from the right compares a suffix with the chain of next smaller suffixes
  behind it. Of the neighbours in the chain the length of the match is known, so a comparison is settled by the two lengths, and only where
  they are equal words are compared, from there on. Such a comparison ends where it comes to a pair of places that has been matched
  before, as one of either direction (next or previous smaller suffix): that extension is taken over, so periods are read once,
  not once for each repetition. A matched stretch is also followed to the left, and places in it take over what was settled for their twins.
  Words are only compared with each other: no suffix array, no suffix tree, no hash. Comparisons were 1 to 5 a word in texts of random words,
  powers and Fibonacci-like words of any length; in Thue-Morse words, whose stretches end at once to the left, 0.5 for each doubling of the length.
* Words become numbers that are ordered and equal as they are: short ones by their bytes, longer ones by their rank in the batch.
* All but the last period of a run of exponent k with period q are words that occur again after q words. Words that do not occur again, or not
  within a (k-1)th of the stretch of such words around them, cut a text; what lies between is what the Lyndon pass reads. This loses no run.

Each text is worked on alone and whole; there is no shuffle, and a task holds one Arrow batch.

Defined cases: null, empty and blank texts have no words and no runs, their collapsed text is empty; repeated rows are each answered; a null id
stays null; ties do not arise, runs are a set in order of start, then period; words of any length and number are read whole; extra columns are not
carried, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, slices, small_arrow_batches
from .words import text_bytes, word_bounds

SLICE_BYTES = 4 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"
_NONE = np.iinfo(np.int64).max


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word data[start:end], equal for equal words only."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    size = ends - starts
    heads = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))[starts].astype(np.uint64)
    short = size <= 7
    cut = (np.uint64(64) - 8 * np.minimum(size, 7).astype(np.uint64))
    values = (heads >> cut << cut) | size.astype(np.uint64)
    if len(long := np.flatnonzero(~short)):
        bounds = np.r_[0, np.cumsum(size[long])]
        at = np.repeat(starts[long] - bounds[:-1], size[long]) + np.arange(bounds[-1])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(long), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[at])])
        values[long] = pc.rank(words, tiebreaker="dense").to_numpy().astype(np.uint64) << np.uint64(8) | np.uint64(255)
    return values


def live_stretches(values: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches that hold all but the last period of any run. bounds: of the texts in values."""
    n = len(values)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.argsort(values, kind="stable")
    a, b = order[:-1], order[1:]
    again = np.full(n, _NONE)
    same = (values[a] == values[b]) & (text[a] == text[b])
    again[a[same]] = (b - a)[same]
    live = again != _NONE
    while True:
        edge = np.flatnonzero(np.diff(np.r_[False, live, False]))
        begins, ends = edge[::2], edge[1::2]
        keep = ends - begins >= least - 1
        begins, ends = begins[keep], ends[keep]
        size = ends - begins
        inside = np.repeat(begins - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        ok = again[inside] <= np.repeat(size // (least - 1), size)
        if ok.all():
            return begins, ends
        live = np.zeros(n, bool)
        live[inside[ok]] = True


def lyndon_array(x: list[int]) -> tuple[list[int], list[int]]:
    """For each place its next smaller suffix (the length of x if there is none; the end is smaller than any word) and the words that both share.

    x[i : smaller[i]] is the longest Lyndon word at i.
    """
    n = len(x)
    smaller, shared = [n] * (n + 1), [0] * (n + 1)
    larger_of, before = [-1] * (n + 1), [0] * (n + 1)  # previous smaller suffix of each place, and the words that both share
    low, high, d = n, n, 0  # x[low:high] is x[low + d : high + d]
    for i in range(n - 1, -1, -1):
        if d and low == i + 1 and x[i] == x[i + d]:
            # what was settled inside of the matched stretch for i + d holds for i
            low, twin, j, end = i, i + d, i + d + 1, smaller[i + d]
            inside = end < n and end + shared[twin] < high + d
            while inside and j != end:
                inside, j = j + before[j] < high + d, smaller[j]
            if inside:
                j = twin + 1
                while j != end:
                    larger_of[j - d], before[j - d], j = i, before[j], smaller[j]
                smaller[i], shared[i] = end - d, shared[twin]
                continue
        j, k, longest, match = i + 1, 0, 0, 0
        if j < n and x[i] == x[j]:
            k = 1 + (shared[j] if smaller[j] == j + 1 else before[j + 1])
        while j < n:
            if k > longest:
                longest, match = k, j
            if j + k == n or x[j + k] <= x[i + k]:
                break
            larger_of[j], before[j] = i, k
            known, j = shared[j], smaller[j]
            if j == n:
                k = 0
            elif k > known:
                k = known
            elif k == known:
                a, b = i + k, j + k
                while b < n and x[a] == x[b]:
                    if smaller[a] == b:
                        k += shared[a]
                        break
                    if larger_of[b] == a:
                        k += before[b]
                        break
                    a, b, k = a + 1, b + 1, k + 1
        smaller[i], shared[i] = j, k if j < n else 0
        if longest and (low != i or i + longest > high):
            low, high, d = i, i + longest, match - i
    return smaller[:n], shared[:n]


def word_runs(x: np.ndarray, least: int = 4, shortest: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in x with length >= max(shortest, least * period), by start, then period."""
    _, x = np.unique(x, return_inverse=True)
    n, found = len(x), set()
    for order in (x, -x):
        smaller, shared = (np.array(v, np.int64) for v in lyndon_array(order.tolist()))
        p = smaller - np.arange(n)
        for i in np.flatnonzero((smaller < n) & (shared > (least - 2) * p)).tolist():
            q, begin = int(p[i]), i
            if i >= q and smaller[i - q] == i and shared[i - q] >= q:
                continue  # a period before it starts with the same root
            while begin and x[begin - 1] == x[begin - 1 + q]:
                begin -= 1
            length = int(smaller[i] + shared[i]) - begin
            if length >= max(shortest, least * q):
                found.add((begin, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def text_runs(texts: pa.Array, least: int, shortest: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """For each text its runs, and its words but for the repetitions in them, joined by one space."""
    data, bounds = text_bytes(texts)
    starts, ends = word_bounds(data, bounds[:-1][bounds[:-1] < len(data)])
    values = word_values(data, starts, ends)
    first = np.searchsorted(starts, bounds)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(values):
        begins, stops = live_stretches(values, first, least)
        owner = np.searchsorted(first, begins, side="right") - 1
        for b, e, t in zip(begins.tolist(), stops.tolist(), owner.tolist(), strict=True):
            end = min(e + (e - b) // (least - 1), int(first[t + 1]))
            # runs of the next stretch lie in the margin only in part; that stretch has them whole
            runs[t] += [(b + s - int(first[t]), n, q) for s, n, q in word_runs(values[b:end], least, shortest) if b + s + n - q <= e]
    whole, left = data.tobytes(), []
    for t, own in enumerate(runs):
        words = whole[bounds[t] : bounds[t + 1]].split()
        if own:
            own.sort(key=lambda r: (r[0], r[2]))
            step = np.zeros(len(words) + 1, np.int64)
            for s, n, q in own:
                step[s + q] += 1
                step[s + n] -= 1
            words = [w for w, d in zip(words, np.cumsum(step[:-1]).tolist(), strict=True) if not d]
        left.append(b" ".join(words))
    return runs, left


def periodic_runs(docs: DataFrame, least: int = 4, shortest: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, runs (start, length, period; by start, then period) of at least `least` periods and `shortest` words, and
    collapsed, the words that are not in a run after its first period, joined by one space."""
    if least < 2:
        raise ValueError("runs repeat at least twice")
    small_arrow_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES):
                found, left = text_runs(texts.slice(a, b - a), least, shortest)
                lists = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in own] for own in found], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array([x.decode() for x in left], pa.string())], ["_id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_id long, runs {RUNS}, collapsed string").withColumnRenamed("_id", id_col)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of ties that of the smallest start, then period. Null without runs."""

    def better(best: Column, r: Column) -> Column:
        more = r["length"] * best["period"] > best["length"] * r["period"]
        return F.when(best.isNull() | more, r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def run_list(runs: Column) -> Column:
    """start,length,period and a line feed of each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")


def with_planted_periods(docs: DataFrame, every: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text of docs, where every tenth document, by a checksum of its id, repeats a few of its words from some word on."""
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    g = F.floor(h / every)
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD_PATTERN), F.lit(0))
    n = F.size("_words").cast("long")
    a = F.pmod(F.col("_g"), n)
    begin, period = F.col("_a"), F.lit(1) + F.floor((n - F.col("_a")) / (3 + F.pmod(F.col("_g"), F.lit(8))))
    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), g.alias("_g"), F.when(h % every == 0, words).alias("_words"))
    placed = chosen.withColumn("_a", F.when(n > 0, a)).withColumn("_p", period)
    changed = F.array_join(F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", (F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p"))).cast("int")))), " ")
    return placed.select(F.col("_id").alias(id_col), F.when(n > 0, changed).otherwise(F.col("_text")).alias(text_col))
