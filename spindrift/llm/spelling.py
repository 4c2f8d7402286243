"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by Aho-Corasick automata of halves.

1. Words are counted: tasks pre-aggregate the words of their texts, so the shuffle carries distinct words of a task, not occurrences.
2. Each word has two segments, its left and its right half. One edit leaves one of them as it is: the left one at the start of the
   other word, the right one at its end. The right halves are looked for in reversed words, so both are at offset 0.
3. An automaton shard holds the segments of a bounded number of words. Words with a common half agree in its first KEY code points, so
   the words that a shard scans are those of its keys; every word is scanned on both sides, in all shards of its key. Keys of many words
   are cut into a grid of pieces (words whose segments an automaton holds) and blocks (words that it scans), both of bounded size.
4. A hit counts at offset 0 only, and leads to words of a compatible length: one shorter, equal or one longer. Of the rest behind a half one
   half again stands as it is, so the words of a hit are looked up by their first three quarters, or by their first half and last quarter,
   and a half that very many words share gives no more candidates than a rare one.
5. The common prefix and suffix of candidates give the exact distance. A pair is counted on the left side, or on the right one if its left
   half has changed; each task sums up what it found for a word, and the sums of all shards are added.

Defined cases: null, empty and blank texts have no words; rows that repeat an id are all counted; a null id counts under the name "null" where
the caller's change of words uses ids; ties go to the smallest word in code-point order; words of any length are compared whole; extra columns
are not read, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_arrow_batches
from .words import mix64

SHORTEST = 7
KEY = 3
PIECE = 100_000
HELD_WORDS = 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def thinned(doc_id: int | None, every: int = 31) -> Callable[[bytes], bytes]:
    """Words of a document, where one in `every`, by a checksum, has lost a letter: a planted misspelling."""
    start = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())

    def change(word: bytes) -> bytes:
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % every:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return change


def word_counts(docs: DataFrame, shortest: int = SHORTEST, least: int = 2, change: Callable | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: maximal runs of Latin letters, A-Z lower-cased, of at least `shortest` code points that occur `least` times or more.

    change, of a document's id, gives a function of a word that only shortens it, applied before lengths are compared.
    """
    small_arrow_batches(docs.sparkSession)
    # all letters are Latin-1, one byte each; what is not becomes a question mark. lower() of bytes changes A-Z only
    pattern = re.compile(rb"[a-z\xc0-\xff]{%d,}" % shortest)

    def run(batches):
        held: dict[bytes, int] = {}

        def out():
            table = pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays(list(table), ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                edit = change(doc) if change else None
                for word in pattern.findall((text.as_py() or "").encode("latin-1", "replace").lower()):
                    if edit:
                        word = edit(word)
                        if len(word) < shortest:
                            continue
                    held[word] = held.get(word, 0) + 1
                if len(held) >= HELD_WORDS:
                    yield out()
        yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Ragged:
    """Words one behind the other, with hashes of any part of them."""

    def __init__(self, words: list[bytes]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.r_[0, np.cumsum(self.size)]
        self.data = np.frombuffer(b"".join(words), np.uint8)
        powers = mix64(_STEP * np.arange(1, 257, dtype=np.uint64))
        n = len(self.data)
        factor = np.uint64(0xD6E8FEB86659FD93)
        self.up, self.down = _powers(factor, n + 1), _powers(np.uint64(pow(int(factor), -1, 1 << 64)), n + 1)
        self.sums = np.r_[np.uint64(0), np.cumsum(powers[self.data] * self.up[:n], dtype=np.uint64)]

    def part(self, word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of word[begin:end]."""
        a = self.at[word] + begin
        return (self.sums[self.at[word] + end] - self.sums[a]) * self.down[a]


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(int(factor), len(out), 1 << 64))])
    return out[:n]


def common(a: Ragged, i: np.ndarray, b: Ragged, j: np.ndarray, backward: bool) -> np.ndarray:
    """Lengths of the common prefixes, or suffixes, of the words a[i] and b[j]."""
    most = np.minimum(a.size[i], b.size[j])
    out, open_ = np.zeros(len(i), np.int64), np.arange(len(i))
    x, y = (a.at[i + 1] - 1, b.at[j + 1] - 1) if backward else (a.at[i], b.at[j])
    step = 0
    while len(open_):
        open_ = open_[most[open_] > step]
        move = -step if backward else step
        open_ = open_[a.data[x[open_] + move] == b.data[y[open_] + move]]
        out[open_] += 1
        step += 1
    return out


def half(size: np.ndarray, side: int) -> np.ndarray:
    """Code points of the segment: the left half, on the reversed side the right one."""
    return size // 2 if side == 0 else size - size // 2


def hits(words: list[bytes], segments: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, segment, length) for each segment that stands at offset 0 of a word, by one automaton over all words."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for s, number in segments.items():
        automaton.add_word(s.decode("latin-1"), number)
    automaton.make_automaton()
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    starts = np.r_[0, np.cumsum([len(w) + 1 for w in words])]
    found = np.array(list(automaton.iter(b"\n".join(words).decode("latin-1"))), np.int64).reshape(-1, 2)
    at = found[:, 0] + 1 - lengths[found[:, 1]]
    word = np.searchsorted(starts, at, side="right") - 1
    keep = starts[word] == at
    return word[keep], found[keep, 1], lengths[found[keep, 1]]


def near_pairs(scanned: list[bytes], held: list[bytes], side: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of scanned[i] and held[j] at distance 1 that this side counts. On side 1 words are reversed."""
    none = np.zeros(0, np.int64)
    if not scanned or not held:
        return none, none
    v, w = Ragged(scanned), Ragged(held)
    h = half(w.size, side)
    segments: dict[bytes, int] = {}
    of = np.fromiter((segments.setdefault(x[:n], len(segments)) for x, n in zip(held, h.tolist(), strict=True)), np.int64, len(held))
    word, segment, length = hits(scanned, segments)
    quarter = (w.size - h) // 2
    everything = np.arange(len(held))
    pairs = []
    # a half of a length belongs to words of two lengths at most: 2h and the next, or 2h and the one before
    for extra in (0, 1) if side == 0 else (0, -1):
        total = 2 * length + extra
        fits = np.abs(total - v.size[word]) <= 1
        i, s, size = word[fits], segment[fits], total[fits]
        lead = length[fits] + (size - length[fits]) // 2  # the first half and the next quarter
        tail = size - lead
        # which: the quarter behind the half stands, or the last one
        for key_w, key_v, ok in (
            (w.part(everything, np.zeros_like(h), h + quarter), v.part(i, np.zeros_like(i), np.minimum(lead, v.size[i])), lead <= v.size[i]),
            (w.part(everything, h + quarter, w.size), v.part(i, np.maximum(v.size[i] - tail, 0), v.size[i]), tail <= v.size[i]),
        ):
            key_w = mix64(key_w ^ mix64(of.astype(np.uint64) << np.uint64(20) ^ w.size.astype(np.uint64) * _STEP))
            key_v = mix64(key_v ^ mix64(s.astype(np.uint64) << np.uint64(20) ^ size.astype(np.uint64) * _STEP))
            order = np.argsort(key_w)
            low, high = (np.searchsorted(key_w[order], key_v[ok], side=x) for x in ("left", "right"))
            n = high - low
            j = order[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            pairs.append((np.repeat(i[ok], n), j))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    code = np.unique(i * len(held) + j)
    i, j = code // len(held), code % len(held)
    prefix, suffix = common(v, i, w, j, False), common(v, i, w, j, True)
    sizes = v.size[i], w.size[j]
    longest = np.maximum(*sizes)
    near = (np.abs(sizes[0] - sizes[1]) <= 1) & (prefix + suffix >= longest - 1) & ~((sizes[0] == sizes[1]) & (prefix == longest))
    near &= prefix >= h[j]  # what hashes say is made sure of
    if side == 1:
        near &= suffix < w.size[j] // 2  # else the left side counts it
    return i[near], j[near]


def _sided(words: DataFrame) -> DataFrame:
    sides = F.array(F.struct(F.lit(0).alias("_side"), F.col("word").alias("_w")), F.struct(F.lit(1).alias("_side"), F.reverse("word").alias("_w")))
    return words.select("n", F.explode(sides).alias("_s")).select("n", "_s.*", F.concat(F.col("_s._side").cast("string"), F.substring("_s._w", 1, KEY)).alias("_key"))


def near_words(words: DataFrame, piece: int = PIECE) -> DataFrame:
    """word, n_near, _best (-n, word of the near word of largest n): for each word with a near one. words: word (distinct), n."""
    rows = words.count()
    sided = _sided(words)
    shards = max(1, 4 * rows // piece)
    keys = materialise(sided.groupBy("_key").agg(F.count(F.lit(1)).alias("_words")), "spelling-keys")
    # keys of more words than a piece number fewer than two for each piece of the table; they alone are broadcast
    large = keys.filter(F.col("_words") > piece).select("_key", F.ceil(F.col("_words") / piece).alias("_cuts"))
    placed = sided.join(F.broadcast(large), "_key", "left").withColumn("_cuts", F.coalesce("_cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("_w", F.lit(7)), F.col("_cuts"))
    every = F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1)
    # a group of the grid: (piece whose segments it holds, block that it scans)
    held = F.transform(every, lambda b: F.struct(own.alias("_piece"), b.alias("_block"), F.lit(True).alias("_held")))
    scanned = F.transform(every, lambda p: F.struct(p.alias("_piece"), own.alias("_block"), F.lit(False).alias("_held")))
    spread = placed.select("_side", "_key", "_w", "n", "_cuts", F.explode(F.concat(held, scanned)).alias("_g"))
    name = F.when(F.col("_cuts") > 1, F.xxhash64("_key", "_g._piece", "_g._block")).otherwise(F.pmod(F.xxhash64("_key"), F.lit(shards)))
    grid = spread.select(name.alias("_group"), "_side", F.col("_g._held").alias("_held"), F.col("_w").alias("_word"), F.col("n").alias("_n"))

    def run(table: pa.Table) -> pa.Table:
        sides, holds, counts = (table.column(c).to_numpy() for c in ("_side", "_held", "_n"))
        names = np.array([x.encode("latin-1") for x in table.column("_word").to_pylist()], object)
        found: list[tuple[str, int, int, str]] = []
        for side in (0, 1):
            a, b = np.flatnonzero((sides == side) & ~holds), np.flatnonzero((sides == side) & holds)
            i, j = near_pairs(names[a].tolist(), names[b].tolist(), side)
            best: dict[int, tuple[int, int, str]] = {}
            for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True):
                word = names[y].decode("latin-1")
                mine = (-int(counts[y]), word[::-1] if side else word)
                n, other = best.get(x, (0, mine))
                best[x] = (n + 1, min(mine, other))
            for x, (n, (less, other)) in best.items():
                word = names[x].decode("latin-1")
                found.append((word[::-1] if side else word, n, less, other))
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "_near", "_less", "_other"])

    found = grid.groupBy("_group").applyInArrow(run, "word string, _near long, _less long, _other string")
    return found.groupBy("word").agg(F.sum("_near").alias("n_near"), F.min(F.struct("_less", "_other")).alias("_best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow from a word. forms: word, form. Each form is more frequent than its word, so there are no
    circles; paths are doubled, so rounds are the logarithm of the longest path."""
    up = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("_moved")), "spelling-forms")
    while not up.filter("_moved").isEmpty():
        above = up.select(F.col("word").alias("root"), F.col("root").alias("_top"))
        up = materialise(up.join(above, "root", "left").select("word", F.coalesce("_top", "root").alias("root"), F.col("_top").isNotNull().alias("_moved")), "spelling-forms")
    return up.select("word", "root")


def variants(words: DataFrame, ratio: int = 10, piece: int = PIECE) -> DataFrame:
    """A row per row of words (word, n): form (its near word of largest n, if that is ratio times its own or more), root, n, n_near, form_n."""
    words = materialise(words.select("word", "n"), "spelling-words")
    near = words.join(near_words(words, piece), "word", "left")
    best = -F.col("_best._less")
    takes = best >= ratio * F.col("n")
    found = near.select("word", F.when(takes, F.col("_best._other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, best).alias("form_n"))
    found = materialise(found, "spelling-near")
    return found.join(roots(found.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = 2, ratio: int = 10, change: Callable | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variants of the words of docs that word_counts gives."""
    return variants(word_counts(docs, shortest, least, change, id_col, text_col), ratio)
