"""Repeated substrings of documents, by interval expansion on a Burrows-Wheeler transform.

Every byte that lies in a string of `length` bytes which also starts somewhere else in the corpus is removed.

1. Each window of `length` bytes is anchored at the smallest hash among its substrings of `core` bytes, a choice that depends on its
   content alone: equal windows have equal anchors. Consecutive windows with the same anchor form a context. Windows of
   different keys (anchor hashes) differ, so only keys that occur more than once go on; a Bloom filter of them
   lets all other anchors stop where they are.
2. Contexts that occur more than once are repeated whole. Of the contexts of one key that differ, some windows may still be equal:
   these contexts, each once, are gathered in bounded blocks of whole keys.
3. In a block the transform of all contexts is built, and intervals are expanded breadth-first by backward extension from the empty string.
   Level l finds the boundaries of the sorted suffixes whose common prefix is l bytes long, in increasing order; expansion stops at
   `length`. Boundaries not found by then part suffixes that agree in `length` bytes: there a window is repeated.

A key with more than hot_contexts different contexts is not gathered: its contexts are halved, each half keyed by the longer core that its
windows share, equal halves are merged, and so on until groups are small; at the end a half is one window and merging decides.

Defined cases: null text is empty; texts shorter than length keep all bytes; null or repeated ids are told apart by text; repeated rows are
occurrences of one another, so both lose all they can; whole texts are read, whatever their length; columns other than id and text are not
read; an empty table gives an empty result. A document is known by 64 bits of its id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, skew_join, slices, small_arrow_batches
from .exact_dedup import RepeatFilter
from .jaccard import _P, mix64

SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20


def substring_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of every substring of n bytes, by doubling."""
    one = data.astype(np.uint64) + np.uint64(1)
    found, size = one, 1
    for bit in bin(n)[3:]:
        found = found[:-size] * np.uint64(pow(int(_P), size, 1 << 64)) + found[size:]
        size *= 2
        if bit == "1":
            found = found[:-1] * _P + one[size:]
            size += 1
    return mix64(found)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    found, size = values, 1
    while size * 2 <= width:
        found = np.minimum(found[:-size], found[size:])
        size *= 2
    rest = width - size
    return np.minimum(found[:-rest], found[rest:]) if rest else found


def anchored_contexts(data: np.ndarray, length: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each context: first window, number of windows, anchor's place from the first window, key."""
    hashes = substring_hashes(data, core)
    width = length - core + 1
    least = sliding_minimum(hashes, width)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    ends = np.r_[starts[1:], len(least)]
    first, count, place = [], [], []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        hits = np.flatnonzero(hashes[a : b + width - 1] == least[a]) + a
        begin = a
        for h in hits.tolist():  # windows up to h have their leftmost minimum at h
            stop = min(b, h + 1)
            if stop > begin:
                first.append(begin)
                count.append(stop - begin)
                place.append(h - begin)
                begin = stop
            if begin >= b:
                break
    first = np.array(first, np.int64)
    return first, np.array(count, np.int64), np.array(place, np.int64), least[first]


def contexts(docs: DataFrame, length: int, core: int) -> DataFrame:
    """_uid, _first, _count, _place, _key, _sig of the contexts of all texts. docs: _uid, _text."""

    def run(batches):
        names = ["_uid", "_first", "_count", "_place", "_key", "_sig"]
        for batch in batches:
            uids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES):
                out = []
                for uid, text in zip(uids[a:b], texts.slice(a, b - a), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    if len(raw) < length:
                        continue
                    first, count, place, key = anchored_contexts(np.frombuffer(raw, np.uint8), length, core)
                    sig = [xxhash.xxh3_64_intdigest(raw[f : f + c + length - 1], p) for f, c, p in zip(first.tolist(), count.tolist(), place.tolist(), strict=True)]
                    out.append((np.full(len(first), uid, np.int64), first, count, place, key.view(np.int64), np.array(sig, np.uint64).view(np.int64)))
                if out:
                    uid, first, count, place, key, sig = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(key), pa.array(sig)], names)

    return docs.mapInArrow(run, "_uid long, _first int, _count int, _place int, _key long, _sig long")


def sorted_suffixes(symbols: np.ndarray, rest: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first `depth` symbols, by prefix doubling. symbols below 257; 0 ends a text; rest: symbols before that end."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key * 257 + np.where(j < rest, padded[j : j + n], 0)
    size = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
        if size >= depth or rank[order[-1]] == n - 1:
            return order
        follows = np.minimum(np.arange(n) + size, n - 1)
        key = rank * (n + 1) + np.where(size <= rest, rank[follows] + 1, 0)
        size *= 2


def shared_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its windows of `length` bytes occur more than once in all texts."""
    sizes = np.array([len(t) for t in texts])
    symbols = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    stops = np.cumsum(sizes + 1) - 1
    starts = stops - sizes
    real = np.ones(len(symbols), bool)
    real[stops] = False
    symbols[real] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    rest = np.repeat(stops, sizes + 1) - np.arange(len(symbols))
    order = sorted_suffixes(symbols, rest, length)
    found = ~boundaries(symbols[order - 1], length)
    repeated = np.zeros(len(symbols), bool)
    repeated[order] = found[:-1] | found[1:]
    repeated &= rest >= length
    return [repeated[a : a + max(0, n - length + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def boundaries(bwt: np.ndarray, length: int) -> np.ndarray:
    """Which of the n + 1 boundaries of the sorted suffixes part suffixes that agree in less than `length` symbols.

    An interval of suffixes that start with w is extended backward: its rows with the symbol c before them map to the interval of
    cw, next to one another. Its right end is a boundary whose common prefix is the length of w, if no shorter one was found there
    before; only such intervals are extended further, so each boundary is found once.
    """
    n = len(bwt)
    by_symbol = np.argsort(bwt, kind="stable")
    image = np.empty(n, np.int64)
    image[by_symbol] = np.arange(n)
    ordered = bwt[by_symbol]
    first = np.searchsorted(ordered, np.arange(258))
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    mark = np.zeros(n + 2, np.int64)  # mark[i + 1]: the interval that row i was mapped from
    for level in range(length):
        if not len(low):
            break
        sizes = high - low
        ends = np.cumsum(sizes)
        rows = np.arange(ends[-1]) + np.repeat(low - ends + sizes, sizes)
        group = np.repeat(np.arange(1, len(low) + 1), sizes)
        symbol = bwt[rows]
        if level:  # an end of text is extended no further
            inner = symbol > 0
            rows, group, symbol = rows[inner], group[inner], symbol[inner]
        to = image[rows]
        mark[to + 1] = group
        opens = (mark[to] != group) | (to == first[symbol])
        closes = (mark[to + 2] != group) | (to + 1 == first[symbol + 1])
        mark[to + 1] = 0
        low, high = np.sort(to[opens]), np.sort(to[closes]) + 1
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
    return known


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def repeated_ranges(docs: DataFrame, length: int = 200, core: int = 64, hot_contexts: int = 4096) -> DataFrame:
    """_uid, _from, _to: runs of windows of texts that are repeated in the corpus. docs: _uid, _text, one row per document."""
    n = docs.count()
    found = materialise(contexts(docs, length, core), "contexts")
    rows = found.count()
    repeated_keys = materialise(found.groupBy("_key").count().filter("count > 1").select("_key"), "context-keys")
    likely = RepeatFilter(repeated_keys, "_key", repeated_keys.count(), least=1).mark(found, "_key").filter("_suspect").drop("_suspect")
    likely = materialise(likely, "contexts-likely")
    where = F.min(F.struct("_uid", "_first", "_count", "_place")).alias("_at")
    distinct = materialise(likely.groupBy("_key", "_sig").agg(F.count(F.lit(1)).alias("_rows"), where), "contexts-distinct")
    # contexts that occur again as they are
    pair = F.struct("_key", "_sig").alias("_pair")
    again = skew_join(likely.withColumn("_pair", pair), distinct.filter("_rows > 1").select(pair, "_rows"), "_pair", rows, "_rows")
    whole = again.select("_uid", F.col("_first").alias("_from"), (F.col("_first") + F.col("_count")).alias("_to"))
    # keys of several contexts: cut these from their texts
    several = distinct.groupBy("_key").agg(F.count(F.lit(1)).alias("_contexts")).filter("_contexts > 1")
    several = materialise(several, "context-keys-several")
    wanted = skew_join(distinct, several, "_key", rows, "_contexts").select("_key", "_at.*", (F.col("_rows") == 1).alias("_need"))
    cut = materialise(_cut(wanted, docs, n, length), "contexts-cut")
    small, parts = _halved(cut, length, hot_contexts, rows)
    blocks = max(1, small.count() * (length + core) // BLOCK_BYTES)
    blocked = small.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(blocks)))

    def expand(table: pa.Table) -> pa.Table:
        out = []
        uids, firsts, needs = (table.column(c).to_pylist() for c in ("_uid", "_first", "_need"))
        texts = table.column("_bytes").to_pylist()
        for uid, first, need, flags in zip(uids, firsts, needs, shared_windows(texts, length), strict=True):
            if need:
                out += [(uid, first + a, first + b) for a, b in _ranges(flags)]
        kinds = [pa.int64(), pa.int32(), pa.int32()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, kinds, strict=True)], ["_uid", "_from", "_to"])

    expanded = blocked.select("_block", "_uid", "_first", "_need", "_bytes").groupBy("_block").applyInArrow(expand, "_uid long, _from int, _to int")
    out = whole.unionByName(expanded)
    for part in parts:
        out = out.unionByName(part)
    return materialise(out, "repeated-ranges")


def _cut(wanted: DataFrame, docs: DataFrame, n: int, length: int) -> DataFrame:
    """wanted contexts with their bytes. Only texts that hold one are shuffled."""
    asked = wanted.groupBy("_uid").agg(F.collect_list(F.struct("_key", "_first", "_count", "_place", "_need")).alias("_asked"))
    asked = materialise(asked, "contexts-asked")
    texts = RepeatFilter(asked, "_uid", n, least=1).mark(docs, "_uid").filter("_suspect").select("_uid", "_text")
    texts = texts.dropDuplicates(["_uid"])
    each = texts.join(asked, "_uid").select("_uid", F.col("_text").cast("binary").alias("_raw"), F.explode("_asked").alias("_a"))
    piece = F.substring(F.col("_raw"), F.col("_a._first") + 1, F.col("_a._count") + (length - 1))
    return each.select("_uid", "_a.*", piece.alias("_bytes"))


def _halved(cut: DataFrame, length: int, hot_contexts: int, rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """Contexts of keys that are small enough, and ranges that merging equal halves of the others has shown to be repeated."""
    small, parts = [], []
    while True:
        sizes = cut.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
        hot = materialise(sizes.filter(F.col("_n") > hot_contexts), "contexts-hot")
        if hot.isEmpty():
            small.append(cut)
            break
        # fewer than rows / hot_contexts keys; broadcast while that is a small number, else joined with splitting of skewed parts
        bounded = F.broadcast if hot.count() <= 100_000 else (lambda df: df)
        marked = cut.join(bounded(hot), "_key", "left")
        small.append(marked.filter("_n is null").drop("_n"))
        # a window's distance from the anchor is _place - (its number); halves are split at the same distance in all contexts
        half = marked.filter("_n is not null").drop("_n")
        bounds = half.groupBy("_key").agg(F.min(F.col("_place") - F.col("_count") + 1).alias("_low"), F.max("_place").alias("_top"))
        half = half.join(bounded(bounds), "_key").withColumn("_mid", F.floor((F.col("_low") + F.col("_top")) / 2).cast("int"))
        # far windows: distance above _mid, the first ones; near windows: the others
        far = F.greatest(F.lit(0), F.least(F.col("_count"), F.col("_place") - F.col("_mid")))
        first = half.withColumn("_c", far).withColumn("_f", F.lit(0)).withColumn("_lo", F.col("_mid") + 1).withColumn("_hi", F.col("_top"))
        second = half.withColumn("_c", F.col("_count") - far).withColumn("_f", far).withColumn("_lo", F.col("_low")).withColumn("_hi", F.col("_mid"))
        both = first.unionByName(second).filter("_c > 0 and _lo <= _hi")
        place = F.col("_place") - F.col("_f")
        piece = F.substring(F.col("_bytes"), F.col("_f") + 1, F.col("_c") + (length - 1))
        # all windows of a half hold the bytes from _lo before the anchor to length - _hi behind it
        core = F.substring(F.col("_bytes"), F.col("_place") - F.col("_lo") + 1, F.lit(length) + F.col("_lo") - F.col("_hi"))
        both = both.select("_uid", F.xxhash64("_key", "_lo", "_hi", core).alias("_key"), (F.col("_first") + F.col("_f")).alias("_first"), F.col("_c").alias("_count"), place.alias("_place"), "_need", piece.alias("_bytes"))
        both = materialise(both.withColumn("_pair", F.struct("_key", F.xxhash64("_bytes", "_place").alias("_sig"))), "contexts-halves")
        at = F.min(F.struct("_uid", "_first", "_count", "_place", "_bytes")).alias("_at")
        merged = materialise(both.groupBy("_pair").agg(F.count(F.lit(1)).alias("_rows"), F.bool_and("_need").alias("_need"), at), "contexts-merged")
        equal = merged.filter("_rows > 1 or not _need").select("_pair", "_rows")
        parts.append(skew_join(both.filter("_need"), equal, "_pair", rows, "_rows").select("_uid", F.col("_first").alias("_from"), (F.col("_first") + F.col("_count")).alias("_to")))
        cut = materialise(merged.select("_at._uid", F.col("_pair._key").alias("_key"), "_at._first", "_at._count", "_at._place", (F.col("_need") & (F.col("_rows") == 1)).alias("_need"), "_at._bytes"), "contexts-cut")
    out = small[0]
    for s in small[1:]:
        out = out.unionByName(s)
    return materialise(out, "contexts-small"), parts


def remove_repeats(docs: DataFrame, length: int = 200, core: int = 64, hot_contexts: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, n_bytes, n_removed, n_spans, spans (removed runs of bytes), kept (the bytes that stay)."""
    small_arrow_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(id_col, text).alias("_uid"), text.alias("_text"))
    ranges = repeated_ranges(docs.select("_uid", "_text"), length, core, hot_contexts)
    spans = materialise(ranges.distinct().groupBy("_uid").agg(F.collect_list(F.struct("_from", "_to")).alias("_spans")), "repeated-spans")
    marked = RepeatFilter(spans, "_uid", max(1, docs.count()), least=1).mark(docs, "_uid")
    touched = marked.filter("_suspect").join(spans, "_uid", "left").select("_id", "_text", "_spans")
    none = F.lit(None).cast("array<struct<_from:int,_to:int>>").alias("_spans")
    rows = marked.filter(~F.col("_suspect")).select("_id", "_text", none).unionByName(touched)

    def run(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, runs = text.encode(), []
                for a, b in sorted((s["_from"], s["_to"] + length - 1) for s in found or []):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(runs), [{"from": a, "to": b} for a, b in runs], kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.binary()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return rows.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, spans array<struct<from:bigint,to:bigint>>, kept binary")
