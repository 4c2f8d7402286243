"""Exact deduplication by two-pass Bloom filtering.

Pass one sets, for each text hash, three bits of a blocked Bloom filter and keeps a second filter of
the bits that were set twice. A row whose three bits are not all in the second filter is certainly
unique: it passes straight through. Only the other rows, the possibly repeated ones, shuffle.

The filter grows with the keys, 16 bits for each. Up to max_bits it is broadcast: 4096 bits a row,
at most about 1.1 KB each, 18 MB for the default 2**26 bits. Beyond, at some 4 million keys, it is joined with the rows by block,
so no task holds more than its blocks; then the rows that it tests shuffle once. Suspects are decided by SHA-256.

Defined cases: null text counts as empty; empty texts are equal to each other; null doc_id sorts
last; of repeated rows (same doc_id, same text) exactly one is kept; texts are compared whole; extra columns stay as they are whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise, skew_join

BLOCK_BITS = 4096
NO_ID = (1 << 63) - 1


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", ""), 256))


class RepeatFilter:
    """A Bloom filter of the digests that may occur `least` times or more in keys[digest_col]."""

    def __init__(self, keys: DataFrame, digest_col: str, rows: int, max_bits: int = 1 << 26, least: int = 2):
        bits = 1 << 16
        while bits < 16 * rows:
            bits *= 2
        self.small = bits <= max_bits
        self.blocks = bits // BLOCK_BITS
        marks = keys.select(self._block(F.col(digest_col)).alias("_block"), F.explode(F.array_distinct(F.array(*self._bits(F.col(digest_col))))).alias("_bit"))
        twice = marks.groupBy("_block", "_bit").count().filter(F.col("count") >= least)
        words = twice.groupBy("_block", (F.shiftright("_bit", 6)).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, _bit & 63))").alias("_set"))
        of_word = words.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_set"))).alias("_of"))
        # a list is looked up by place, a map is searched
        every = F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1))
        self.table = of_word.select("_block", F.transform(every, lambda w: F.coalesce(F.element_at("_of", w), F.lit(0).cast("long"))).alias("_words"))

    def _block(self, digest: Column) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.blocks)).cast("int")

    def _bits(self, digest: Column) -> list[Column]:
        h = F.xxhash64(digest, F.lit(1))
        return [F.shiftright(h, s).bitwiseAND(BLOCK_BITS - 1).cast("int") for s in (0, 12, 24)]

    def mark(self, df: DataFrame, digest_col: str) -> DataFrame:
        """df with _suspect: false only where the digest is surely unique. No shuffle while the filter is small enough to broadcast."""
        digest = F.col(digest_col)
        hits = [F.coalesce(F.getbit(F.get("_words", F.shiftright(b, 6)), b.bitwiseAND(63)), F.lit(0).cast("tinyint")) == 1 for b in self._bits(digest)]
        joined = df.withColumn("_block", self._block(digest)).join(F.broadcast(self.table) if self.small else self.table, "_block", "left")
        return joined.withColumn("_suspect", hits[0] & hits[1] & hits[2]).drop("_block", "_words")


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("_id"), text_digest(text).alias("_sha"), F.coalesce(F.length(text), F.lit(0)).alias("_n"))


def _keepers(suspects: DataFrame) -> DataFrame:
    """For each digest its number of rows and the row that stays."""
    best = F.min(F.struct((-F.col("_n")).alias("less"), F.coalesce("_id", F.lit(NO_ID)).alias("id")))
    out = suspects.groupBy("_sha").agg(F.count(F.lit(1)).alias("_rows"), best.alias("_best"))
    return out.select("_sha", "_rows", (-F.col("_best.less")).alias("_keep_n"), F.when(F.col("_best.id") != NO_ID, F.col("_best.id")).alias("_keep"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 26) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept and the digest (hex) of the text without white space."""
    slim = materialise(_slim(docs, id_col, text_col), "exact-keys")
    rows = slim.count()
    marked = RepeatFilter(slim, "_sha", rows, max_bits).mark(slim, "_sha")
    sha = F.lower(F.hex("_sha")).alias("text_sha256")
    alone = marked.filter(~F.col("_suspect")).select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    suspects = marked.filter("_suspect")
    members = suspects.groupBy("_sha", "_id", "_n").agg(F.count(F.lit(1)).alias("_same"))
    found = skew_join(members, _keepers(suspects), "_sha", rows, "_rows").withColumn("_copy", F.explode(F.expr("sequence(1L, _same)")))
    kept = (F.col("_copy") == 1) & F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_n") == F.col("_keep_n"))
    return alone.unionByName(found.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_rows").alias("group_size"), kept.alias("kept"), sha))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 26) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their columns. Only possibly repeated rows shuffle."""
    slim = materialise(_slim(docs, id_col, text_col), "exact-keys")
    rows = slim.count()
    seen = RepeatFilter(slim, "_sha", rows, max_bits)
    text = F.col(text_col)
    full = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), text_digest(text).alias("_sha"), F.coalesce(F.length(text), F.lit(0)).alias("_n"))
    marked = seen.mark(full, "_sha")
    winners = _keepers(seen.mark(slim, "_sha").filter("_suspect"))
    # joined on all three columns, so the copies of one text spread over all tasks
    w = winners.select(F.col("_sha").alias("_w_sha"), F.coalesce("_keep", F.lit(NO_ID)).alias("_w_id"), F.col("_keep_n").alias("_w_n"))
    on = (F.col("_sha") == F.col("_w_sha")) & (F.coalesce("_id", F.lit(NO_ID)) == F.col("_w_id")) & (F.col("_n") == F.col("_w_n"))
    kept = marked.filter("_suspect").join(w, on, "left_semi").dropDuplicates(["_sha"])
    return marked.filter(~F.col("_suspect")).unionByName(kept).select("_row.*")
