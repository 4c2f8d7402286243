"""Best-fit packing of tokenised documents into sequences of a fixed capacity, in bulk-synchronous rounds.

Documents and gaps are sorted by size. In a round each document, longest first, is matched with its successor, the smallest gap that
holds it; conflicts for a gap are resolved by rank, the losers moving on to the next larger gap; then all matched gaps shrink at once
and the next round begins. It starts with as many empty sequences as the tokens need at least, and opens more only
when no gap is left that holds a document.

Lengths are integers up to the capacity, so documents of one length are interchangeable: the tables of a round hold classes
(length, range of ranks) and (gap, range of sequences), whose number is bounded by the capacity, not by the input. They are sorted into bands of
sizes, swept by running sums within bands and over bands, and written to the shared folder after each round; the driver sees a few sums alone.
Each document finds its place from its length and its rank within the length: its number within its task plus the counts of the tasks before.

Defined cases: null or empty texts are the single id 0; documents longer than the capacity are cut into pieces; repeated rows
are packed as often as they occur; of equal lengths any order is as good; ids may be null; columns of docs other than id and text are not read; an
empty table gives no sequences.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_BYTES, materialise, slices, small_arrow_batches
from .words import WordHasher, chunks, lowered, text_bytes, word_bounds

KNOWN_PIECES = 1_000_000
SLICE_BYTES = 2 << 20
BAND = 64
CLASS_ROWS = 50_000


# The split rule of tokenizers whose pieces are known by heart here, and the classes of bytes that it follows from.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = b".,;:!?%*&$#|\"()[]{}<>=+/~^`_-@\\"
_KIND = np.full(256, 4, np.uint8)  # 0 space, 1 letter, 2 mark, 3 digit, 4 anything that may belong to its neighbours
_KIND[list(SPACE_BYTES)] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[list(MARKS)] = 2
_KIND[48:58] = 3
_PARTED = np.array([[x != y and (4 not in (x, y) or 0 in (x, y)) or x == y == 3 for y in range(5)] for x in range(5)])


class WordTokenizer:
    """Ids of whole texts from a tokenizer that splits by SPLIT: white space, letters, single digits and marks never join.

    Texts are cut where that rule cuts them for certain, between ASCII letters, digits, marks and white space, but not around signs of the
    tokenizer's added tokens. Each distinct piece is encoded once, without regard to case where it is of ASCII without such signs, and known
    from then on by 128 bits of hashes. Pieces of letters alone are encoded together: each ends with an id that ends a word. A tokenizer
    with another rule encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, vocabulary = tokenizer.encode_batch_fast, tokenizer.get_vocab()
        with open(path) as file:
            rules = json.load(file)
        steps = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        first = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.pieces = steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": SPLIT} and rules["model"].get("end_of_word_suffix") == "</w>"
        added = b"".join(t["content"].encode() for t in rules.get("added_tokens") or [])
        self.pieces &= not set(added) & set(SPACE_BYTES)
        self.kinds = _KIND.copy()
        self.kinds[[b for b in added if _KIND[b] != 1]] = 4
        self.spared = self.kinds == 4
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.hashers = WordHasher(1, lower=False), WordHasher(2, lower=False)
        self.forget()

    def forget(self) -> None:
        # known pieces by two hashes: the sorted first ones, the second ones, and the numbers of the pieces; ids of piece n lie between ends n and n + 1
        self.keys, self.checks, self.places = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ends = array("I"), array("q", [0])

    def _find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.keys, first), len(self.keys) - 1)
        return np.where((self.keys[at] == first) & (self.checks[at] == second), self.places[at], -1)

    def _know(self, first: np.ndarray, second: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(first, kind="stable")
        first, second, places = first[order], second[order], places[order]
        at = np.searchsorted(self.keys, first)
        self.keys, self.checks, self.places = np.insert(self.keys, at, first), np.insert(self.checks, at, second), np.insert(self.places, at, places)

    def _store(self, ids: list[int], ends) -> int:
        base, first = len(self.ids), len(self.ends) - 1
        self.ids.extend(ids)
        self.ends.extend(base + e for e in ends)
        return first

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """The numbers of new pieces, encoded here."""
        places = np.zeros(len(pieces), np.int64)
        plain = [i for i, w in enumerate(pieces) if w.isascii() and w.isalpha()]
        other = [i for i, w in enumerate(pieces) if not (w.isascii() and w.isalpha())]
        parts = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for part, e in zip(parts, self.encode([" ".join([pieces[i] for i in p]) for p in parts], add_special_tokens=False) if parts else [], strict=True):
            ids = e.ids
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) == len(part):
                first = self._store(ids, ends)
                places[part] = np.arange(first, first + len(part))
            else:
                other += part
        for i, e in zip(other, self.encode([pieces[i] for i in other], add_special_tokens=False) if other else [], strict=True):
            places[i] = self._store(e.ids, [len(e.ids)])
        return places

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the bounds of each text in it."""
        if not self.pieces:
            found = [e.ids for e in self.encode(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.uint32), np.cumsum([0, *map(len, found)])
        if len(self.keys) > KNOWN_PIECES:
            self.forget()
        data, bounds = text_bytes(texts)
        parts, within = [np.zeros(0, np.uint32)], np.zeros(len(bounds), np.int64)
        for a, b in chunks(data):
            starts, stops = word_bounds(data[a:b], bounds[np.searchsorted(bounds, a) : np.searchsorted(bounds, b)] - a, self.kinds, _PARTED)
            ids, ends = self._ids(lowered(data[a:b], starts, stops, self.spared), starts, stops)
            parts.append(ids)
            within += np.r_[0, ends][np.searchsorted(starts + a, bounds)]
        return np.concatenate(parts), within

    def _ids(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces of one chunk, and where those of each end."""
        first, second = (h.hashes(data, starts, stops) for h in self.hashers)
        place = self._find(first, second)
        if len(missing := np.flatnonzero(place < 0)):
            order = missing[np.lexsort((second[missing], first[missing]))]
            heads = np.r_[True, (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])]
            new = order[heads]
            found = self._learn([data[a:b].tobytes().decode() for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)])
            self._know(first[new], second[new], found)
            place[order] = found[np.cumsum(heads) - 1]
        edges, pool = np.frombuffer(self.ends, np.int64), np.frombuffer(self.ids, np.uint32) if len(self.ids) else np.zeros(0, np.uint32)
        lengths = edges[place + 1] - edges[place]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(edges[place] - ends + lengths, lengths)
        return pool[at], ends


@cache
def tokenizer_of(path: str) -> WordTokenizer:
    """One for each worker process, so words stay known from task to task."""
    return WordTokenizer(path)


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """id, piece, start, length and ids_crc32 of each piece of each document."""
    small_arrow_batches(docs.sparkSession)

    def run(batches):
        tokens = tokenizer_of(tokenizer)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            out = []
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES):
                flat, bounds = tokens(texts.slice(a, b - a))
                for k in range(b - a):
                    ids = np.concatenate([flat[bounds[k] : bounds[k + 1]], end])
                    out += [(keys[a + k], p, s, len(x := ids[s : s + capacity]), zlib.crc32(x.astype("<u4").tobytes())) for p, s in enumerate(range(0, len(ids), capacity))]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long")


def _numbered(pieces: DataFrame, id_col: str) -> DataFrame:
    """pieces with _part, the task that read them, and _nth, the number of pieces of this length before it in the task."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            order = np.argsort(lengths, kind="stable")
            own = lengths[order]
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[heads, len(own)])
            nth = np.zeros(len(own), np.int64)
            nth[order] = np.arange(len(own)) - np.repeat(heads, sizes) + np.repeat([seen[n] for n in own[heads].tolist()], sizes).astype(np.int64)
            for n, c in zip(own[heads].tolist(), sizes.tolist(), strict=True):
                seen[n] += c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part, np.int64)), pa.array(nth)], [*batch.schema.names, "_part", "_nth"])

    return pieces.mapInArrow(run, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, _part long, _nth long")


def _few(rows: DataFrame, n: int) -> DataFrame:
    """A class table in as many tasks as its rows ask for, mostly one: then no step of a round shuffles."""
    return rows.coalesce(1) if n <= CLASS_ROWS else rows


def _items(docs: DataFrame, each: int, top: int) -> DataFrame:
    """What a round offers of the classes docs (length, rank, n): (size, length, rank, unit, n).

    Where documents outnumber the gaps that may hold them, they are offered in bundles of unit documents of one length, `each` at most: half
    of what a gap will get. So rounds stay few however short documents are.
    """
    fits = F.least(F.lit(each), F.col("n"), F.floor(F.lit(top) / F.col("length")))
    unit = F.when(fits >= 2, F.pow(F.lit(2), F.floor(F.log2(fits.cast("double"))))).otherwise(1).cast("long")
    docs = docs.withColumn("unit", unit).withColumn("whole", F.floor(F.col("n") / F.col("unit")))
    whole = F.struct((F.col("length") * F.col("unit")).alias("size"), "length", "rank", "unit", F.col("whole").alias("n"))
    rest = F.struct(F.col("length").alias("size"), "length", (F.col("rank") + F.col("whole") * F.col("unit")).alias("rank"), F.lit(1).cast("long").alias("unit"), (F.col("n") - F.col("whole") * F.col("unit")).alias("n"))
    return docs.select(F.explode(F.array(whole, rest)).alias("i")).select("i.*").filter("n > 0")


def _sweep(docs: DataFrame, gaps: DataFrame, each: int, top: int, capacity: int, n: int) -> DataFrame:
    """One round. docs: length, rank, n. gaps: size, rank (the first sequence), n. Rows of three kinds, told by `what`:

    placed: n items of unit documents from rank on, one to each sequence from `first` on, at `offset`; docs and gaps: what is left, for the next round.

    Sorted by size, largest first and gaps before documents, gaps are pushed on a stack and documents pop it: the top is the smallest
    gap that holds a document, its successor. Running sums give each class the levels of the stack that it fills or takes, within bands of
    sizes first and then over the bands. A document meets the gap that is last on its level: so conflicts are resolved by rank.
    """
    none = F.lit(0).cast("long")
    events = gaps.select(F.lit(0).alias("pop"), "size", none.alias("length"), "rank", none.alias("unit"), "n")
    events = _few(events.unionByName(_items(docs, each, top).withColumn("pop", F.lit(1))), n)
    events = events.withColumn("_band", F.floor(F.col("size") / BAND)).withColumn("_signed", F.when(F.col("pop") == 0, F.col("n")).otherwise(-F.col("n")))
    place = [F.desc("size"), F.col("pop"), F.col("length"), F.col("rank")]
    within = Window.partitionBy("_band").orderBy(*place)
    until = within.rowsBetween(Window.unboundedPreceding, -1)
    scanned = events.withColumn("_sum", F.coalesce(F.sum("_signed").over(until), none)).withColumn("_low", F.least(F.min(F.col("_sum")).over(within.rowsBetween(Window.unboundedPreceding, 0)), none))
    # one row for each band: capacity / BAND at most
    bands = scanned.groupBy("_band").agg(F.sum("_signed").alias("_all"), F.min(F.least(F.col("_low"), F.col("_sum") + F.col("_signed"))).alias("_least"))
    above = Window.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("_before", F.coalesce(F.sum("_all").over(above), none))
    bands = bands.select("_band", "_before", F.least(F.coalesce(F.min(F.col("_before") + F.col("_least")).over(above), none), none).alias("_floor"))
    level = F.col("_before") + F.col("_sum") - F.least(F.col("_floor"), F.col("_before") + F.col("_low"))
    spans = scanned.join(bands.hint("merge"), "_band").withColumn("_level", level).withColumn("_taken", F.least("_level", "n"))
    low = F.when(F.col("pop") == 0, F.col("_level")).otherwise(F.col("_level") - F.col("_taken"))
    high = F.when(F.col("pop") == 0, F.col("_level") + F.col("n")).otherwise(F.col("_level"))
    spans = materialise(spans.select("pop", "size", "length", "rank", "unit", "n", "_taken", low.alias("_low"), high.alias("_high")), "pack-levels")

    # levels cut wherever a class begins or ends, two cuts for each class
    cuts = _few(spans, n).select(F.explode(F.array("_low", "_high")).alias("_at")).distinct()
    order = Window.orderBy("_at")
    cuts = cuts.select("_at", F.row_number().over(order).alias("_cut"), (F.lead("_at").over(order) - F.col("_at")).alias("_width"))
    lows, highs = cuts.select(F.col("_at").alias("_low"), F.col("_cut").alias("_from")), cuts.select(F.col("_at").alias("_high"), F.col("_cut").alias("_to"))
    pieces = _few(spans, n).filter("_low < _high").join(lows.hint("merge"), "_low").join(highs.hint("merge"), "_high").withColumn("_cut", F.explode(F.expr("sequence(_from, _to - 1)")))
    pieces = pieces.join(cuts.hint("merge"), "_cut")
    turn = Window.partitionBy("_cut").orderBy(*place)
    gap = F.lag(F.struct("size", "rank", "_low")).over(turn)
    pieces = pieces.withColumn("_gap", gap).withColumn("_met", F.lead("pop").over(turn)).withColumn("_step", F.col("_at") - F.col("_low"))
    placed = pieces.filter("pop = 1").groupBy("length", "size", "unit", F.col("rank").alias("_own"), F.col("_gap.size").alias("_room"), F.col("_gap.rank").alias("_first"), F.col("_gap._low").alias("_base"), F.col("_low"))
    placed = placed.agg(F.min("_at").alias("_at"), F.sum("_width").alias("n"))
    placed = placed.select(F.lit("placed").alias("what"), "size", "length", (F.col("_own") + (F.col("_at") - F.col("_low")) * F.col("unit")).alias("rank"), "unit", "n", (F.col("_first") + F.col("_at") - F.col("_base")).alias("first"), (capacity - F.col("_room")).alias("offset"))
    free = pieces.filter("pop = 0 and _met is null").groupBy("size", "rank", "_low").agg(F.min("_at").alias("_at"), F.sum("_width").alias("n"))
    free = free.select(F.lit("gaps").alias("what"), "size", none.alias("length"), (F.col("rank") + F.col("_at") - F.col("_low")).alias("rank"), none.alias("unit"), "n", none.alias("first"), none.alias("offset"))
    left = spans.filter("pop = 1 and _taken < n").select(F.lit("docs").alias("what"), "size", "length", (F.col("rank") + F.col("_taken") * F.col("unit")).alias("rank"), "unit", ((F.col("n") - F.col("_taken")) * F.col("unit")).alias("n"), none.alias("first"), none.alias("offset"))
    return placed.unionByName(free).unionByName(left)


def _finish(docs: DataFrame, gaps: DataFrame, capacity: int, opened: int) -> DataFrame:
    """The plan of the last few documents, `capacity` at most, in one task: one after the other, longest first, each into the smallest gap that holds it."""

    def run(batches):
        waiting, free = [], defaultdict(list)
        for batch in batches:
            for pop, size, rank, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if pop:
                    waiting += [(size, r) for r in range(rank, rank + n)]
                else:
                    free[size].append((rank, n))
        sizes, out, new = sorted(free), [], opened
        for size, rank in sorted(waiting, reverse=True):
            i = bisect_left(sizes, size)
            if i == len(sizes):
                free[capacity] = [(new, 1)]
                sizes.append(capacity)
                new += 1
            gap = sizes[i]
            first, n = free[gap].pop()
            if n > 1:
                free[gap].append((first + 1, n - 1))
            if not free[gap]:
                del free[gap], sizes[i]
            out.append((size, rank, 1, 1, first, capacity - gap))
            if gap > size:
                if gap - size not in free:
                    insort(sizes, gap - size)
                free[gap - size].append((first, 1))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["length", "rank", "unit", "n", "first", "offset"])

    both = docs.select(F.lit(1).alias("pop"), F.col("length").alias("size"), "rank", "n").unionByName(gaps.select(F.lit(0).alias("pop"), "size", "rank", "n"))
    return both.coalesce(1).mapInArrow(run, "length long, rank long, unit long, n long, first long, offset long")


def plan_rounds(counts: DataFrame, capacity: int) -> DataFrame:
    """The plan: rows (length, rank, unit, n, first, offset), from counts (length, n).

    Classes of documents and gaps stay in tables; a few sums of each round tell the driver whether to open sequences or to end.
    """
    plan = "length", "rank", "unit", "n", "first", "offset"
    docs = counts.select("length", F.lit(0).cast("long").alias("rank"), "n")
    gaps = docs.select(F.col("length").alias("size"), "rank", "n").limit(0)
    plans, opened, state = [], 0, docs.select(F.lit("docs").alias("what"), F.col("length").alias("size"), "length", F.lit(0).alias("offset"), "n")
    while True:
        # sums of each band of sizes, capacity / BAND of them
        room = F.when(F.col("what") == "docs", F.col("length")).when(F.col("what") == "gaps", F.col("size")).otherwise(capacity - F.col("offset") - F.col("size"))
        sums = state.select((F.col("what") == "docs").alias("waits"), room.alias("room"), "n").filter("room > 0").groupBy("waits", F.floor(F.col("room") / BAND).alias("band"))
        sums = sums.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("room")).alias("tokens"), F.min("room").alias("least"), F.max("room").alias("top"), F.count(F.lit(1)).alias("rows")).collect()
        waiting, free = [r for r in sums if r["waits"]], [r for r in sums if not r["waits"]]
        if not waiting:
            break
        least, top, rows = min(r["least"] for r in waiting), max([0, *(r["top"] for r in free)]), sum(r["rows"] for r in sums)
        holding = sum(r["n"] for r in free if r["top"] >= least)
        if top < least:
            new = -(-sum(r["tokens"] for r in waiting) // capacity)
            gaps = gaps.unionByName(counts.sparkSession.range(1).select(F.lit(capacity).cast("long").alias("size"), F.lit(opened).cast("long").alias("rank"), F.lit(new).cast("long").alias("n")))
            opened, top, rows, holding = opened + new, capacity, rows + 1, new
        waits = sum(r["n"] for r in waiting)
        if waits <= capacity:
            plans.append(materialise(_finish(docs, gaps, capacity, opened), "pack-round").select(*plan))
            break
        state = materialise(_sweep(docs, gaps, waits // (2 * holding), top, capacity, rows), "pack-round")
        placed = state.filter("what = 'placed'")
        plans.append(placed.select(*plan))
        shrunk = placed.filter(F.col("offset") + F.col("size") < capacity).select((capacity - F.col("offset") - F.col("size")).alias("size"), F.col("first").alias("rank"), "n")
        gaps = state.filter("what = 'gaps'").select("size", "rank", "n").unionByName(shrunk)
        docs = state.filter("what = 'docs'").select("length", "rank", "n")
        state = _few(state, rows)
    if not plans:
        return docs.select("length", "rank", *[F.col("n").alias(c) for c in plan[2:]])
    return reduce(DataFrame.unionByName, plans)


def pack(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """pieces (id, piece, start, length, ids_crc32) with sequence_id and offset."""
    numbered = materialise(_numbered(pieces.select(id_col, "piece", "start", "length", "ids_crc32"), id_col), "pieces")
    sizes = materialise(numbered.groupBy("length", "_part").agg(F.max("_nth").alias("_last")), "pack-sizes")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_part", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_before"))
    counts = materialise(sizes.groupBy("length").agg(F.sum(F.col("_last") + 1).alias("n")), "pack-classes")
    plan = plan_rounds(counts, capacity).select(F.col("length").alias("_length"), F.col("rank").alias("_first_rank"), "unit", (F.col("n") * F.col("unit")).alias("_ranks"), F.col("first").alias("_first"), F.col("offset").alias("_offset"))
    rank = F.col("_nth") + F.col("_before")
    ranked = numbered.join(offsets, ["length", "_part"]).withColumn("_rank", rank)
    # the plan's size is bounded by the capacity, whatever the input
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first_rank")) & (F.col("_rank") < F.col("_first_rank") + F.col("_ranks"))
    step = F.col("_rank") - F.col("_first_rank")
    sequence = (F.col("_first") + F.floor(step / F.col("unit"))).cast("long").alias("sequence_id")
    offset = (F.col("_offset") + step % F.col("unit") * F.col("length")).cast("long").alias("offset")
    return ranked.join(F.broadcast(plan), on).select(id_col, "piece", "start", "length", "ids_crc32", sequence, offset)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    return pack(tokenized_pieces(docs, tokenizer, capacity, id_col, text_col, end_id), capacity, id_col)
