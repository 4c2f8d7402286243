"""Near-duplicate components by min-max hashing.

1. One pass hashes each document's set of word shingles under PERMUTATIONS permutations of 32 bits and keeps the smallest and the largest value of
   each. Both are equal for two sets with probability their Jaccard similarity, so a signature has two unbiased values for each hash
   that is evaluated; as the two samples of one permutation hardly overlap, they vary less than those of two permutations.
2. Signatures are banded: BANDS bands of ROWS values from different permutations, minima in the one half, maxima in the other. Documents of
   equal bands share a bucket. Sets that link (similarity 0.85) share none of 32 buckets with probability 7e-9.
3. Documents with equal sets are represented by the smallest id. In each bucket the other documents meet one leader, the one that meets
   most documents in all its buckets; pairs are confirmed on full sets.
4. Where a bucket's documents then lie in more than one component, the shingles that a document shares with any other one in such buckets are
   counted. They bound its overlap with each of them: rows that this parts from all sizes in their bucket are done. Of the rest those outside of the
   bucket's largest component meet all others, WIDTH at a time and eight times as many in each later round, but for pairs that the bound
   parts, until none is left: no bucket is cut and none gives all its pairs at once, and a pair is made in the first bucket that it shares alone. Documents of one component are not compared any more.

A bucket's leader is found by aggregation, and buckets that hold more than a thousandth of all rows, fewer than a thousand for each band, are joined by
broadcasts of one row a bucket.

Defined cases: null, empty or blank texts have no shingle and link with nothing; a text of fewer than k words is one shingle; a null id
links with nothing, its component is null and its row is kept; rows that repeat an id are answered each, and are one document that links if one
of its texts does; ties go to the smallest id; texts are read whole; extra columns are not carried, so their names cannot clash; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, skew_join, slices, small_arrow_batches
from .components import components
from .exact_dedup import RepeatFilter
from .jaccard import SLICE_BYTES, Shingler, confirmed, sketches
from .words import mix64

PERMUTATIONS, BANDS, ROWS = 80, 32, 5
WIDTH, PIECE = 64, 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)


class MinMax:
    """Min-max signatures: values 0 to m - 1 are the minima under m permutations, m to 2m - 1 the maxima."""

    def __init__(self, permutations: int = PERMUTATIONS, seed: int = 0):
        drawn = mix64(_STEP * np.arange(1 + 2 * seed * permutations, 1 + 2 * (seed + 1) * permutations, dtype=np.uint64))
        self.factors = (drawn[:permutations] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.shifts = (drawn[permutations:] >> np.uint64(32)).astype(np.uint32)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row per set of hashes, none of them empty."""
        m = len(self.factors)
        out = np.zeros((2 * m, len(sets)), np.uint32)
        if sets:
            begins = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
            items = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
            moved = np.empty_like(items)
            for p in range(m):
                np.bitwise_xor(items, self.shifts[p], out=moved)
                np.multiply(moved, self.factors[p], out=moved)
                np.minimum.reduceat(moved, begins, out=out[p])
                np.maximum.reduceat(moved, begins, out=out[m + p])
        return out.T


def bands(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash for each band of each signature: consecutive values, with the number of the band."""
    n = signatures.shape[1] // rows
    values = signatures[:, : n * rows].reshape(-1, n, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(n, dtype=np.uint64), values.shape[:2])
    for r in range(rows):
        out = mix64((out ^ values[:, :, r]) + _STEP)
    return out


def signed(docs: DataFrame, k: int, permutations: int, rows: int) -> DataFrame:
    """_id, _n (size of the set), _set (a digest of it), _bands of each document (_id, _text)."""

    def run(batches):
        shingler, hasher = Shingler(k), MinMax(permutations)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES):
                sets = shingler.shingles(texts.slice(a, b - a))
                full = [i for i, s in enumerate(sets) if len(s)]
                found = bands(hasher.signatures([sets[i] for i in full]), rows)
                counts = np.zeros(len(sets) + 1, np.int32)
                counts[np.array(full, np.int64) + 1] = found.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(found.ravel().view(np.int64)))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists], ["_id", "_n", "_set", "_bands"])

    return materialise(docs.mapInArrow(run, "_id long, _n long, _set binary, _bands array<long>"), "minmax-signed")


def near_components(docs: DataFrame, k: int = 5, t: tuple[int, int] = (85, 100), permutations: int = PERMUTATIONS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, n_shingles, component_id (the smallest id it is linked with, through others or not), kept."""
    small_arrow_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = signed(docs, k, permutations, rows)
    total = found.count()
    usable = found.filter("_n > 0 and _id is not null")
    groups = usable.groupBy("_set").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_rows"), F.first("_n").alias("_n"), F.first("_bands").alias("_bands"))
    groups = materialise(groups, "minmax-sets")
    equal = skew_join(usable.select("_set", "_id"), groups.filter("_rows > 1").select("_set", "_rep", "_rows"), "_set", total, "_rows")
    stars = equal.filter("_id <> _rep").select(F.col("_id").alias("a"), F.col("_rep").alias("b")).distinct()
    cells = groups.select(F.explode("_bands").alias("_bucket"), F.col("_rep").alias("_id"), "_n")
    labels = components(_links(docs, cells, groups.select(F.col("_rep").alias("_id"), "_bands"), k, t, total).unionByName(stars))
    out = found.select("_id", "_n").join(labels.select(F.col("node").alias("_id"), "component"), "_id", "left")
    component = F.coalesce("component", "_id")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def _links(docs: DataFrame, cells: DataFrame, sets: DataFrame, k: int, t: tuple[int, int], total: int) -> DataFrame:
    """Links (a, b) that connect just what all links connect. cells: _bucket, _id, _n, one set for each row of a bucket; sets: _id, _bands."""
    salts = max(16, total // 20_000)
    sizes = cells.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    met = materialise(skew_join(cells, sizes, "_bucket", total, "_size"), "minmax-cells")
    # the leader of a bucket is the document that meets most others in all its buckets: the text that copies were made of, where it is there
    weights = met.groupBy("_id").agg(F.sum("_size").alias("_weight"))
    first = F.min(F.struct((-F.col("_weight")).alias("_less"), F.xxhash64("_id").alias("_h"), "_id", "_n"))
    leaders = met.join(weights, "_id").groupBy("_bucket").agg(first.alias("_lead"), F.count(F.lit(1)).alias("_rows"))
    led = skew_join(met, leaders, "_bucket", total, "_rows")
    pairs = _pairs(led.filter((F.col("_id") != F.col("_lead._id")) & _fits(F.col("_n"), F.col("_lead._n"), t)), F.col("_id"), F.col("_lead._id"))
    named = met.select("_id").distinct()
    texts = RepeatFilter(named, "_id", total, least=1).mark(docs.filter("_id is not null"), "_id").filter("_suspect").select("_id", "_text")
    texts = materialise(texts, "minmax-texts")
    bits = sketches(texts, k)
    tried = materialise(pairs, "minmax-pairs")
    labels = components(confirmed(tried, texts, bits, k, t, salts))
    open_, width, shared = _open(met.drop("_size"), labels, total), WIDTH, None
    while not open_.isEmpty():
        if shared is None:
            shared = materialise(_shared(open_, texts, k), "minmax-shared")
            open_ = _possible(open_.drop("_component", "_largest", "_size").join(shared, "_id"), t, total)
            # the bands of a document tell the first bucket that two share
            open_ = _open(open_, labels, total).join(sets, "_id")
            continue
        # those outside of the largest component, the first of them by a hash: Spark cuts such a ranking before it shuffles
        order = Window.partitionBy("_bucket").orderBy(F.xxhash64("_id"), "_id")
        leads = open_.filter("_component <> _largest").select("_bucket", "_id", F.row_number().over(order).alias("_r")).filter(F.col("_r") <= width)
        ranked = materialise(open_.join(leads, ["_bucket", "_id"], "left").withColumn("_leads", F.col("_r").isNotNull()).drop("_r", "_largest"), "minmax-open")
        fresh = materialise(_met(ranked, t).join(tried, ["a", "b"], "left_anti"), "minmax-pairs")
        labels = components(_stars(labels).unionByName(confirmed(fresh, texts, bits, k, t, salts)))
        tried = materialise(tried.unionByName(fresh), "minmax-pairs")
        open_, width = _open(ranked.filter("not _leads").drop("_leads", "_component", "_size"), labels, total), width * 8
    return _stars(labels)


def _can(common, n1, n2, t: tuple[int, int]):
    """Whether sets of these sizes that share `common` at most can link."""
    return common * (t[0] + t[1]) >= (n1 + n2) * t[0]


def _met(rows: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(a, b): each leading row of a bucket with the others that it can link with. A pair is made in the first band that both share alone.

    Large buckets are cut into pieces by a hash of the id, to each of which all leading rows go.
    """
    pieces = F.ceil(F.col("_size") / PIECE)
    others = rows.withColumn("_piece", F.pmod(F.xxhash64("_id"), pieces)).withColumn("_leads", F.lit(False))
    leading = rows.filter("_leads").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    shards = max(1, rows.count() // PIECE)
    units = others.unionByName(leading).withColumn("_unit", F.pmod(F.xxhash64("_bucket", "_piece"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        bucket, piece, ids, n, common, component, leads = (table.column(c).to_numpy() for c in ("_bucket", "_piece", "_id", "_n", "_shared", "_component", "_leads"))
        held = table.column("_bands").combine_chunks()
        all_bands = held.flatten().to_numpy().reshape(len(held), -1) if len(held) else np.zeros((0, 1), np.int64)
        order = np.lexsort((piece, bucket))
        starts = np.flatnonzero(np.r_[True, (bucket[order][1:] != bucket[order][:-1]) | (piece[order][1:] != piece[order][:-1])])
        found = [np.zeros((0, 2), np.int64)]
        for own in np.split(order, starts[1:]):
            x, y = own[leads[own]], own[~leads[own]]
            for begin in range(0, len(x), 64):
                i = x[begin : begin + 64]
                fits = (n[i][:, None] * t[1] >= n[y][None] * t[0]) & (n[y][None] * t[1] >= n[i][:, None] * t[0])
                enough = np.minimum(common[i][:, None], common[y][None]) * (t[0] + t[1]) >= (n[i][:, None] + n[y][None]) * t[0]
                p, q = np.nonzero((component[i][:, None] != component[y][None]) & fits & enough)
                first = (all_bands[i[p]] == all_bands[y[q]]).argmax(1)
                keep = all_bands[i[p], first] == bucket[own[0]]
                found.append(np.sort(np.stack([ids[i[p[keep]]], ids[y[q[keep]]]], axis=1), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 1]), "b": pa.array(pairs[:, 0])})

    names = ["_unit", "_bucket", "_piece", "_id", "_n", "_shared", "_component", "_leads", "_bands"]
    return units.select(*names).groupBy("_unit").applyInArrow(run, "a long, b long").distinct()


def _shared(rows: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """_id, _shared: how many of its shingles a document of rows has in common with any other document of rows."""

    def run(batches):
        shingler = Shingler(k)
        for batch in batches:
            for a, b in slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), SLICE_BYTES):
                sets = shingler.shingles(batch.column(1).slice(a, b - a))
                ids = np.repeat(batch.column(0).slice(a, b - a).to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], ["_id", "_token"])

    ids = rows.select("_id").distinct()
    tokens = texts.join(ids, "_id", "left_semi").mapInArrow(run, "_id long, _token long")
    # a token of one document alone is told by aggregation, without bringing a token's documents together
    found = tokens.groupBy("_token").agg(F.min("_id").alias("_id"), F.max("_id").alias("_last")).filter("_id = _last")
    alone = found.groupBy("_id").agg(F.count(F.lit(1)).alias("_alone"))
    sized = rows.groupBy("_id").agg(F.max("_n").alias("_n")).join(alone, "_id", "left")
    # rows that repeat an id may hold several sets: for these the bound is what it would be without counting
    several = texts.groupBy("_id").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1")
    alone = F.when(F.col("_texts").isNull(), F.coalesce("_alone", F.lit(0))).otherwise(F.lit(0))
    return sized.join(several, "_id", "left").select("_id", F.greatest(F.col("_n") - alone, F.lit(0)).alias("_shared"))


def _possible(rows: DataFrame, t: tuple[int, int], total: int) -> DataFrame:
    """Rows that can link with a set of a size that their bucket holds, by what they share with others."""
    sizes = rows.groupBy("_bucket").agg(F.min("_n").alias("_least"), F.count(F.lit(1)).alias("_rows"))
    bound = skew_join(rows, sizes, "_bucket", total, "_rows")
    # the smallest partner, which has what is shared at least
    return bound.filter(_can(F.col("_shared"), F.col("_n"), F.greatest("_least", "_shared"), t)).drop("_least", "_rows")


def _fits(n1, n2, t: tuple[int, int]):
    return (n1 * t[1] >= n2 * t[0]) & (n2 * t[1] >= n1 * t[0])


def _pairs(rows: DataFrame, x, y) -> DataFrame:
    return rows.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()


def _stars(labels: DataFrame) -> DataFrame:
    return labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _open(cells: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """The rows of buckets with documents of several components, with the row's component, the one that most rows of the bucket have, and the bucket's rows."""
    names = [c for c in cells.columns if c != "_id"]
    of = cells.join(labels.select(F.col("node").alias("_id"), "component"), "_id", "left").select("_id", *names, F.coalesce("component", "_id").alias("_component"))
    parts = of.groupBy("_bucket", "_component").agg(F.count(F.lit(1)).alias("_rows"))
    mixed = parts.groupBy("_bucket").agg(F.max(F.struct("_rows", "_component")).alias("_top"), F.count(F.lit(1)).alias("_parts"), F.sum("_rows").alias("_size")).filter("_parts > 1")
    mixed = mixed.select("_bucket", F.col("_top._component").alias("_largest"), "_size")
    return materialise(skew_join(of, mixed, "_bucket", total, "_size"), "minmax-open")


def first_of_each(docs: DataFrame, k: int = 5, t: tuple[int, int] = (85, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those linked, directly or through others, to a document of smaller id; whatever columns docs has."""
    dropped = materialise(near_components(docs, k, t, id_col=id_col, text_col=text_col).filter("not kept").select(F.col(id_col).alias("_id")).distinct(), "minmax-dropped")
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"))
    marked = RepeatFilter(dropped, "_id", dropped.count(), least=1).mark(keyed, "_id")
    kept = marked.filter("_suspect").join(dropped, "_id", "left_anti")
    return marked.filter(~F.col("_suspect")).select("_row.*").unionByName(kept.select("_row.*"))
