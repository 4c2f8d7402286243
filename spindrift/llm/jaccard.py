"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles; two link when intersection / union reaches the threshold. The join is exact:

1. One pass counts shingles (lossy counting in each task, sums over tasks) to tell the frequent ones, and gives each document's
   set size and signature. Documents with equal sets are represented by the smallest id.
2. Shingles are ordered, rare ones first. Linked documents share a shingle within their prefixes, the first
   n - ceil(t n) + 1 in that order. A shingle in the prefix of several documents is a cell.
3. Similar documents are partitioned into groups: each document is compared with the documents that lead many of its cells;
   the components of these links are the groups.
4. The token-group matrix has a row for each cell and group, the union of the prefixes of the group. A document's cells are ordered, those
   of few documents first. Documents that share c cells first meet in one from which both have c cells left: this bounds the overlap of two
   groups. If in no common cell the bound, plus what may lie behind a prefix, reaches what the threshold asks of any two of
   their sizes, the pair stays closed. Of pairs that qualify, one document of each group is compared with the other's first; those not linked by it
   are opened, their documents sifted by bit sketches and compared.
   Groups that link are one group from then on; within a group nothing is compared.

Cells of more groups than WIDTH are worked off by leaders, WIDTH groups at a time and four times as many in each later
round, until all groups of the cell have met; no cell is dropped, and no cell gives all its pairs at once. Comparisons read the texts
of the two documents; a leader's text is salted over tasks.

Defined cases: null, empty or blank texts have no shingle and link with nothing; a text of fewer than k words is one shingle, its whole
sequence; A-Z are lower-cased; rows without id link with nothing and have a null component; rows that repeat an id are one
document; whole texts are compared; ties between groups go to the smaller id; extra columns stay as they are whatever their names; an
empty table gives no rows. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, small_arrow_batches
from .components import components
from .exact_dedup import RepeatFilter
from .words import WordHasher, hashed_words, mix64

SLICE_BYTES = 2 << 20
FREQUENT = 500_000
WIDTH = 64
FEW_PAIRS = 20_000
_P = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Hashes of the k-word shingles of texts."""

    def __init__(self, k: int = 5, lower: bool = True):
        self.k, self.hasher = k, WordHasher(lower=lower)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each word of all texts, and the bounds of each text in it."""
        (hashes,), bounds = hashed_words(texts, self.hasher)
        return hashes, bounds

    def shingles(self, texts: pa.Array) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        words, bounds = self.words(texts)
        k = self.k
        rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for i in range(k):
            rolled = rolled * _P + words[i : len(words) - k + 1 + i] if len(rolled) else rolled
        rolled = mix64(rolled)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for w in words[a:b]:
                    h = mix64(np.array([h * _P + w], np.uint64))[0]
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def needed(n: np.ndarray | int, t: tuple[int, int]) -> np.ndarray | int:
    """ceil(t n)."""
    return -(-n * t[0] // t[1])


class LossyCounter:
    """Counts of frequent items, of bounded size: items are merged in large batches, and rare ones fall out when there are too many."""

    def __init__(self, limit: int = 1_000_000):
        self.items, self.counts, self.limit, self.floor = np.zeros(0, np.uint64), np.zeros(0, np.int64), limit, 1
        self.new, self.pending = [], 0

    def add(self, items: np.ndarray) -> None:
        self.new.append(items)
        self.pending += len(items)
        if self.pending >= 2 * self.limit:
            self.merge()

    def merge(self) -> None:
        both = np.concatenate([self.items, *self.new])
        order = np.argsort(both)
        both = both[order]
        weight = np.concatenate([self.counts, np.ones(self.pending, np.int64)])[order]
        starts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
        self.items, self.counts = both[starts], np.add.reduceat(weight, starts) if len(starts) else weight
        self.new, self.pending = [], 0
        while len(self.items) > self.limit:
            keep = self.counts > self.floor
            self.items, self.counts = self.items[keep], self.counts[keep]
            self.floor += len(self.items) > self.limit


def _texts(batch: pa.RecordBatch, at: int):
    texts = batch.column(at)
    for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES):
        yield a, b, texts.slice(a, b - a)


def profile(docs: DataFrame, k: int) -> DataFrame:
    """Rows of two kinds: _id, _n, _sig of each document; _token, _count of shingles that a task saw more than once."""

    def run(batches):
        shingler, counter = Shingler(k), LossyCounter()
        names = ["_id", "_n", "_sig", "_token", "_count"]
        for batch in batches:
            ns, sigs = [], []
            for _, _, texts in _texts(batch, 1):
                sets = shingler.shingles(texts)
                ns += [len(s) for s in sets]
                sigs += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                counter.add(np.concatenate(sets))
            none = pa.nulls(len(ns), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), none, none], names)
        counter.merge()
        keep = counter.counts >= 2
        tokens = pa.array(counter.items[keep].view(np.int64))
        none = pa.nulls(len(tokens), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(tokens), pa.binary()), tokens, pa.array(counter.counts[keep])], names)

    return materialise(docs.mapInArrow(run, "_id long, _n long, _sig binary, _token long, _count long"), "jaccard-profile")


def prefixes(docs: DataFrame, k: int, t: tuple[int, int], frequent: pa.Table) -> DataFrame:
    """_id, _n and _prefix, the hashes of the first n - ceil(t n) + 1 shingles, rare ones first. frequent: _token, _count."""
    tokens = frequent.column("_token").to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(tokens)
    tokens, classes = tokens[by], np.log2(np.maximum(1, frequent.column("_count").to_numpy().astype(np.int64))).astype(np.uint64)[by]

    def run(batches):
        shingler = Shingler(k)
        for batch in batches:
            ns, found = [], []
            for _, _, texts in _texts(batch, 1):
                sets = shingler.shingles(texts)
                flat = np.concatenate(sets)
                rank = flat >> np.uint64(6)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
                    rank = rank | (np.where(tokens[at] == flat, classes[at], np.uint64(0)) << np.uint64(58))
                begin = 0
                for s in sets:
                    n = len(s)
                    p = n - needed(n, t) + 1 if n else 0
                    own = rank[begin : begin + n]
                    # without a frequent one the order is that of the hashes, in which s is already
                    found.append(s[:p] if not n or own.max() >> np.uint64(58) == 0 else s[np.argsort(own, kind="stable")[:p]])
                    ns.append(n)
                    begin += n
            lengths = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), lists], ["_id", "_n", "_prefix"])

    return docs.mapInArrow(run, "_id long, _n long, _prefix array<long>")


def sketches(texts: DataFrame, k: int) -> DataFrame:
    """_id, _n and _bits, the shingles of each text hashed to a power of two of bits, four for each shingle or more."""

    def run(batches):
        shingler = Shingler(k)
        for batch in batches:
            ns, bits = [], []
            for _, _, part in _texts(batch, 1):
                for s in shingler.shingles(part):
                    size = max(512, 1 << (4 * len(s) - 1).bit_length()) if len(s) else 512
                    flags = np.zeros(size, np.uint8)
                    flags[(s & np.uint64(size - 1)).astype(np.int64)] = 1
                    ns.append(len(s))
                    bits.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(bits, pa.binary())], ["_id", "_n", "_bits"])

    return materialise(texts.mapInArrow(run, "_id long, _n long, _bits binary"), "jaccard-sketches")


def may_link(n1: int, bits1: bytes, n2: int, bits2: bytes, t: tuple[int, int]) -> bool:
    """False only if sets of these sizes and sketches cannot link: bits that differ are shingles that only one of the two has."""
    a, b = int.from_bytes(bits1, "little"), int.from_bytes(bits2, "little")
    size = 8 * min(len(bits1), len(bits2))
    if len(bits1) != len(bits2):  # sketches of different sizes are folded to the smaller
        a, b = _folded(a, size), _folded(b, size)
    overlap = (n1 + n2 - (a ^ b).bit_count()) // 2
    return overlap * t[1] >= t[0] * (n1 + n2 - overlap)


def _folded(x: int, size: int) -> int:
    out, mask = 0, (1 << size) - 1
    while x:
        out |= x & mask
        x >>= size
    return out


def _sifted(pairs: DataFrame, bits: DataFrame, t: tuple[int, int], salts: int, narrow: bool = True) -> DataFrame:
    """pairs (a, b) without those that their sketches rule out."""
    pairs = materialise(pairs.select("a", "b").distinct(), "jaccard-pairs")
    if not (n := pairs.count()):
        return pairs
    bits = _only(bits, pairs, n) if narrow or n <= FEW_PAIRS else bits
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("a"), F.lit(salts)))
    left = salted.join(bits.select(F.col("_id").alias("a"), F.col("_n").alias("_na"), F.col("_bits").alias("_ba")), "a")
    right = salted.select("b", "_salt").distinct().join(bits.select(F.col("_id").alias("b"), F.col("_n").alias("_nb"), F.col("_bits").alias("_bb")), "b")
    both = left.join(right, ["b", "_salt"]).select("a", "b", "_na", "_ba", "_nb", "_bb")

    def run(batches):
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            keep = [may_link(*x, t) for x in zip(*cols[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.mapInArrow(run, "a long, b long"), "jaccard-sifted")


def _verify(pairs: DataFrame, texts: DataFrame, bits: DataFrame, k: int, t: tuple[int, int], salts: int, narrow: bool = True) -> DataFrame:
    """(a, b) of pairs that link. texts: _id, _text. b may be in many pairs: its text is sent once for each salt in use. narrow: for where most
    texts are in no pair, however many pairs there are."""
    sifted = _sifted(pairs, bits, t, salts, narrow)
    if not (n := sifted.count()):
        return sifted
    texts = _only(texts, sifted, n) if narrow or n <= FEW_PAIRS else texts
    salted = sifted.withColumn("_salt", F.pmod(F.xxhash64("a"), F.lit(salts)))
    left = salted.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("_ta")), "a")
    right = salted.select("b", "_salt").distinct().join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("_tb")), "b")
    both = left.join(right, ["b", "_salt"]).select("a", "b", "_ta", "_tb")

    def run(batches):
        shingler, last = Shingler(k), (None, None)
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for begin, end, texts_a in _texts(batch, 2):
                for i, mine in zip(range(begin, end), shingler.shingles(texts_a), strict=True):
                    if last[0] != b[i]:
                        last = (b[i], shingler.shingles(batch.column(3).slice(i, 1))[0])
                    common = len(np.intersect1d(mine, last[1], assume_unique=True))
                    if common and common * t[1] >= t[0] * (len(mine) + len(last[1]) - common):
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.int64()) for x in (a, b)], ["a", "b"])

    return materialise(both.mapInArrow(run, "a long, b long"), "jaccard-links")


def _lack(n1, n2, t: tuple[int, int]):
    """The shared cells that two sets of these sizes need at least to link: required overlap less what can lie behind a prefix."""
    s, d = t[0], t[0] + t[1]
    required = F.ceil((n1 + n2) * s / d)
    return required - F.greatest(F.ceil(n1 * s / t[1]), F.ceil(n2 * s / t[1])) + 1


def jaccard_components(docs: DataFrame, k: int = 5, t: tuple[int, int] = (75, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, n_shingles, component_id (the smallest id it is linked with, through others or not)."""
    small_arrow_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = profile(docs, k)
    sizes = found.filter(F.col("_n").isNotNull()).select("_id", "_n", "_sig")
    rows = sizes.count()
    totals = found.filter(F.col("_token").isNotNull()).groupBy("_token").agg(F.sum("_count").alias("_count")).filter("_count >= 8")
    frequent = totals.orderBy(F.desc("_count"), "_token").limit(FREQUENT).toArrow()

    usable = sizes.filter("_n > 0 and _id is not null")
    groups = usable.groupBy("_n", "_sig").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_rows"))
    equal = groups.filter("_rows > 1")
    # who is represented by another: few groups are large, so the ids are found by signature with a bounded broadcast
    from .common import skew_join

    keyed = usable.withColumn("_set", F.struct("_n", "_sig"))
    stand = materialise(skew_join(keyed.select("_set", "_id"), equal.select(F.struct("_n", "_sig").alias("_set"), "_rep", "_rows"), "_set", rows, "_rows").select("_id", "_rep").distinct(), "jaccard-equal")
    copies = stand.filter("_id <> _rep").select("_id")

    links = _links(_without(docs.filter(F.col("_id").isNotNull()), copies, rows), k, t, frequent, rows)
    labels = components(links.unionByName(stand.select(F.col("_id").alias("a"), F.col("_rep").alias("b"))))
    out = sizes.join(labels.select(F.col("node").alias("_id"), "component"), "_id", "left")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("component", "_id").alias("component_id"))


def _member(ids: DataFrame, rows: int) -> RepeatFilter:
    return RepeatFilter(ids, "_id", rows, least=1)


def _without(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """docs whose id is not in ids; only rows that a Bloom filter of ids takes for members shuffle."""
    marked = _member(ids, rows).mark(docs, "_id")
    return marked.filter(~F.col("_suspect")).drop("_suspect").unionByName(marked.filter("_suspect").drop("_suspect").join(ids, "_id", "left_anti"))


def _links(docs: DataFrame, k: int, t: tuple[int, int], frequent: pa.Table, rows: int) -> DataFrame:
    """Links (a, b) that connect just what all links connect. docs: _id, _text, one row per set."""
    salts = max(16, rows // 20_000)
    cells = prefixes(docs, k, t, frequent).filter("_n > 0").select(F.explode("_prefix").alias("_token"), "_id", "_n")
    cell = Window.partitionBy("_token")
    lead = F.min(F.struct(F.xxhash64("_id").alias("_h"), "_id", "_n")).over(cell)
    cells = cells.withColumn("_lead", lead).withColumn("_min", F.min("_id").over(cell)).withColumn("_max", F.max("_id").over(cell)).filter("_min <> _max")
    cells = cells.withColumn("_docs", F.count(F.lit(1)).over(cell))
    cells = materialise(cells.select("_token", "_id", "_n", "_docs", F.col("_lead._id").alias("_lead"), F.col("_lead._n").alias("_lead_n")), "jaccard-cells")
    ids = cells.select("_id").distinct()
    texts = _member(ids, rows).mark(docs, "_id").filter("_suspect").select("_id", "_text")
    texts = materialise(texts, "jaccard-texts")
    bits = sketches(texts, k)

    # groups: each document against the documents that lead many of its cells
    fits = (F.col("_lead_n") * t[1] >= F.col("_n") * t[0]) & (F.col("_n") * t[1] >= F.col("_lead_n") * t[0])
    led = cells.filter("_id <> _lead").filter(fits).groupBy("_id", "_lead", "_n").count()
    led = led.filter(F.col("count") * 16 * t[1] >= F.col("_n") * (t[1] - t[0]))  # a sixteenth of its prefix
    best = Window.partitionBy("_id").orderBy(F.desc("count"), "_lead")
    pairs = led.withColumn("_r", F.row_number().over(best)).filter("_r <= 3").select(F.col("_id").alias("a"), F.col("_lead").alias("b"))
    links = _verify(pairs, texts, bits, k, t, salts)

    # how many cells a document has from each one on, those of few documents first
    behind = F.row_number().over(Window.partitionBy("_id").orderBy(F.desc("_docs"), F.desc("_token"))).cast("long")
    slim, width = cells.select("_token", "_id", "_n", behind.alias("_rest")), WIDTH
    labels = components(links)
    while True:
        grouped = _matrix(slim, labels, t)
        if grouped.isEmpty():
            return _stars(labels)
        opened = materialise(_qualifying(grouped, t, width), "jaccard-opened")
        # documents that stand for their groups first: groups that these link need not be opened
        labels = now = components(_stars(labels).unionByName(_verify(opened.select("a", "b"), texts, bits, k, t, salts)))
        g1, g2 = now.select(F.col("node").alias("_g1"), F.col("component").alias("_c1")), now.select(F.col("node").alias("_g2"), F.col("component").alias("_c2"))
        apart = opened.select("_g1", "_g2").distinct().join(g1, "_g1", "left").join(g2, "_g2", "left").filter(F.coalesce("_c1", "_g1") != F.coalesce("_c2", "_g2"))
        candidates = _candidates(grouped, materialise(apart.select("_g1", "_g2"), "jaccard-apart"), t)
        labels = components(_stars(labels).unionByName(_verify(candidates, texts, bits, k, t, salts)))
        # cells wider than width go on without the groups that have met all others
        slim = grouped.filter((F.col("_size") > width) & (F.col("_r") > width)).select("_token", "_id", "_n", "_rest")
        if slim.isEmpty():
            return _stars(labels)
        width *= 4


def _stars(labels: DataFrame) -> DataFrame:
    """Links (a, b) of each document with its component: they stand for all links so far."""
    return labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _matrix(cells: DataFrame, labels: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The token-group matrix: rows (_token, _id, _n, _rest, _group) of cells that documents of several groups share.

    Each has its group's number in the cell (_r), the number of groups there (_size), and of its group in the cell the range of sizes (_low,
    _high) and the most cells left (_most); _first marks the document that has these, which stands for the group.
    Documents that share c cells first meet in one from which both have c left, so _rest bounds their overlap; cells of two
    documents that this bound parts are left out.
    """
    grouped = cells.join(labels.select(F.col("node").alias("_id"), "component"), "_id", "left").select("_token", "_id", "_n", "_rest", F.coalesce("component", "_id").alias("_group"))
    cell = Window.partitionBy("_token")
    own = Window.partitionBy("_token", "_group")
    ranked = grouped.withColumn("_r", F.dense_rank().over(cell.orderBy("_group"))).withColumn("_size", F.max("_r").over(cell)).filter("_size > 1")
    bound = [F.count(F.lit(1)).over(cell), F.min("_n").over(cell), F.max("_n").over(cell), F.min("_rest").over(cell)]
    ranked = ranked.withColumns(dict(zip(("_docs", "_least", "_top", "_left"), bound, strict=True)))
    apart = (F.col("_docs") == 2) & ((F.col("_least") * t[1] < F.col("_top") * t[0]) | (F.col("_left") < _lack(F.col("_least"), F.col("_top"), t)))
    ranked = ranked.filter(~apart).drop("_docs", "_least", "_top", "_left")
    first = F.row_number().over(own.orderBy(F.desc("_rest"), "_id")) == 1
    ranked = ranked.withColumns({"_low": F.min("_n").over(own), "_high": F.max("_n").over(own), "_most": F.max("_rest").over(own), "_first": first})
    return materialise(ranked, "jaccard-matrix")


def confirmed(pairs: DataFrame, texts: DataFrame, bits: DataFrame, k: int, t: tuple[int, int], salts: int) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have the similarity t, compared as whole sets. texts: _id, _text; bits: their sketches; most of
    both are in a pair, or pairs are few."""
    return _verify(pairs, texts, bits, k, t, salts, narrow=False)


def _least_lack(la, ha, lb, hb, t: tuple[int, int]):
    """The least that sizes of two ranges ask for: as far apart as they may be; one less for rounding where they are ranges."""

    def apart(low, high):
        return _lack(low, F.greatest(low, F.least(high, F.floor(low * t[1] / t[0]))), t)

    exact = (la == ha) & (lb == hb)
    return F.when(exact, _lack(la, lb, t)).otherwise(F.least(apart(la, hb), apart(lb, ha)) - 1)


def _qualifying(matrix: DataFrame, t: tuple[int, int], width: int) -> DataFrame:
    """Pairs of groups (_g1, _g2) with a cell from which both have as many left as the threshold asks for, and in it a document of each (a, b)."""
    rows = matrix.filter("_first")
    sides = [rows.select("_token", F.col("_group").alias(f"_g{x}"), F.col("_r").alias(f"_r{x}"), F.col("_low").alias(f"_l{x}"), F.col("_high").alias(f"_h{x}"), F.col("_most").alias(f"_s{x}"), F.col("_id").alias(x)) for x in "ab"]
    fits = (F.col("_la") * t[0] <= F.col("_hb") * t[1]) & (F.col("_lb") * t[0] <= F.col("_ha") * t[1])
    enough = F.least("_sa", "_sb") >= _least_lack(F.col("_la"), F.col("_ha"), F.col("_lb"), F.col("_hb"), t)
    both = sides[0].filter(F.col("_ra") <= width).join(sides[1], "_token").filter((F.col("_ra") < F.col("_rb")) & fits & enough)
    return both.select(F.least("_ga", "_gb").alias("_g1"), F.greatest("_ga", "_gb").alias("_g2"), "a", "b").distinct()


def _candidates(grouped: DataFrame, opened: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Pairs of documents (a, b) of opened groups that qualify in a cell. The rows of the smaller group lead to those of the larger one."""
    sizes = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    s1, s2 = (sizes.select(F.col("_group").alias(g), F.col("_rows").alias(r)) for g, r in (("_g1", "_m1"), ("_g2", "_m2")))
    both = opened.join(s1, "_g1").join(s2, "_g2")
    swap = F.col("_m1") > F.col("_m2")
    both = both.select(F.when(swap, F.col("_g2")).otherwise(F.col("_g1")).alias("_ga"), F.when(swap, F.col("_g1")).otherwise(F.col("_g2")).alias("_gb"))
    a, b = (grouped.select("_token", F.col("_id").alias(x), F.col("_n").alias(f"_n{x}"), F.col("_group").alias(f"_g{x}"), F.col("_rest").alias(f"_s{x}")) for x in "ab")
    fits = (F.col("_na") * t[0] <= F.col("_nb") * t[1]) & (F.col("_nb") * t[0] <= F.col("_na") * t[1])
    enough = F.least("_sa", "_sb") >= _lack(F.col("_na"), F.col("_nb"), t)
    return both.join(a, "_ga").join(b, ["_token", "_gb"]).filter(fits & enough).select("a", "b").distinct()


def _only(rows: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """rows of documents that one of n pairs names, and perhaps few others: the rest stays where it is."""
    ids = pairs.select(F.col("a").alias("_id")).union(pairs.select("b"))
    if n <= FEW_PAIRS:
        return rows.join(F.broadcast(ids.distinct()), "_id", "left_semi")
    return _member(ids, n).mark(rows, "_id").filter("_suspect").drop("_suspect")


def first_of_each(docs: DataFrame, k: int = 5, t: tuple[int, int] = (75, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those linked, directly or through others, to a document of smaller id."""
    small_arrow_batches(docs.sparkSession)
    found = jaccard_components(docs, k, t, id_col, text_col)
    dropped = materialise(found.filter(f"component_id <> `{id_col}`").select(F.col(id_col).alias("_id")).distinct(), "jaccard-dropped")
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"))
    marked = _member(dropped, dropped.count()).mark(keyed, "_id")
    kept = marked.filter("_suspect").join(dropped, "_id", "left_anti")
    return marked.filter(~F.col("_suspect")).select("_row.*").unionByName(kept.select("_row.*"))
