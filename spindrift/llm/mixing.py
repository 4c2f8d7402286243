"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words: its weight's share of budget times all words, at most
max_repeat times its own words, the excess reshared by weight. Within a source a document's expected number of copies rises with
its size (document_weight), so that the words expected are the target and no document is expected more than max_repeat times. Its whole part
is certain copies; the rest is its inclusion probability p, a different one for each source and size class. Documents are ranked by random
odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order until the source's remaining words are reached.

The cut of each source is found without sorting it: words are summed over 16384 slots of the logarithm of the rank variable, then
over 16384 slots of the slot in which the cut falls; as random odds have a smooth distribution on that scale, whatever p,
what remains to be sorted is less than a millionth of a source, and rows that share an id.

Defined cases: null text has size 0; null source is a source of its own, last in order; a source without
words has target 0; documents of size 0 are never taken; null ids and repeated ids share their u, and of equal (id, size) on the cut any rows
may be taken; u depends on the id and the seed alone, so reruns agree; texts are counted whole; extra columns stay as they are
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise, skew_join, unit_hash

SLOTS = 1 << 14
DIGITS = ("_d1", "_d2")
CUTS = ("_cut_d1", "_cut_d2")
FEW_CELLS = 1000  # what skew_join broadcasts at most
RANGE = 100.0  # of the logarithm of odds, which doubles keep below 75


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, max_repeat: float) -> DataFrame:
    """A row per source: _source_rows, source_size, target. sizes: _source, _size, _rows.

    The windows here run over one row per source.
    """
    each = sizes.groupBy("_source").agg(F.sum("_rows").alias("_source_rows"), F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    each = each.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    # water filling: in order of cap / weight, the first source that keeps its share sets the level for all after it
    rising = Window.orderBy((F.col("_cap") / F.col("_weight")), F.col("_source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget))
    each = each.withColumn("_level", (total - before) / left)
    level = F.min(F.when(F.col("_cap") / F.col("_weight") >= F.col("_level"), F.struct((F.col("_cap") / F.col("_weight")).alias("at"), F.col("_level").alias("level")))).over(Window.partitionBy())
    target = F.least(F.col("_cap"), F.coalesce(level["level"], F.lit(float("inf"))) * F.col("_weight"))
    return each.withColumn("target", target).select("_source", "_source_rows", "source_size", "target")


def document_weight(size_class):
    """How much more often a document is taken than one of a single word, by the power of two of its size: 1 to some 2.5."""
    return F.sqrt(1 + size_class / F.lit(4.0))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("_size"), *more)
    keyed = rows.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("_source").cast("string")), F.lit("n")))
    size_class = F.when(F.col("_size") > 0, F.floor(F.log2(F.col("_size").cast("double")))).otherwise(-1)
    return keyed.withColumn("_class", size_class.cast("int")).withColumn("_cell", F.concat_ws(":", F.col("_class"), F.col("_key")))


def _allocation(sized: DataFrame, weights: tuple[float, ...], budget: float, max_repeat: float) -> DataFrame:
    """A row per source and size class: its documents' certain copies and the probability _p of one more.

    Expected copies rise with document_weight, times a factor of the source that brings the expected words to its target; none is above max_repeat.
    The windows here run over the size classes of one source, some 40 rows.
    """
    classes = sized.groupBy("_source", "_key", "_class", "_cell").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_size").alias("_size"))
    classes = materialise(classes, "mix-classes")
    plan = source_targets(classes.select("_source", "_size", "_rows"), weights, budget, max_repeat)
    plan = plan.select(F.coalesce(F.concat(F.lit("s"), F.col("_source").cast("string")), F.lit("n")).alias("_key"), "_source_rows", "source_size", "target")
    each = classes.drop("_source").join(plan, "_key").withColumn("_weight", F.when(F.col("_class") >= 0, document_weight(F.col("_class"))).otherwise(0.0))
    most = F.lit(float(max_repeat))
    falling = Window.partitionBy("_key").orderBy(F.desc("_class"))
    before = F.coalesce(F.sum("_size").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    left = F.sum(F.col("_size") * F.col("_weight")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    each = each.withColumn("_level", F.when(left > 0, (F.col("target") - before) / left))
    # the largest documents reach max_repeat first; the first class that does not sets the factor
    level = F.min(F.when(F.col("_level") * F.col("_weight") <= most * (1 - 1e-12), F.struct((-F.col("_class")).alias("at"), F.col("_level").alias("level")))).over(Window.partitionBy("_key"))
    copies = F.when(F.col("_class") < 0, F.lit(0.0)).otherwise(F.least(most, F.coalesce(level["level"], F.lit(float("inf"))) * F.col("_weight")))
    each = each.withColumn("_copies", F.greatest(copies, F.lit(0.0))).withColumn("_certain", F.floor(F.col("_copies") + F.lit(1e-12)))
    each = each.withColumn("_p", F.greatest(F.col("_copies") - F.col("_certain"), F.lit(0.0)))
    sure = F.sum(F.col("_certain") * F.col("_size")).over(Window.partitionBy("_key"))
    return each.withColumn("_rest", F.greatest(F.col("target") - sure, F.lit(0.0))).select("_key", "_cell", "_rows", "_source_rows", "source_size", "target", "_certain", "_p", "_rest")


def _met(left: DataFrame, right: DataFrame, key: str, rows: int, size_col: str, few: bool) -> DataFrame:
    """Inner join of left with right, a row per cell or source. few: there are FEW_CELLS cells at most, so all of right is broadcast: one join instead of three, which the driver plans and holds."""
    return left.join(F.broadcast(right), key) if few else skew_join(left, right, key, rows, size_col)


def _ranked(sized: DataFrame, cells: DataFrame, rows: int, few: bool, seed: int, *more: str) -> DataFrame:
    """sized with its allocation, more columns of cells and _z, the log of the document's random odds divided by its inclusion odds, mapped to 0 to 1; null where _p is 0."""
    cells = cells.select("_cell", "_rows", "_source_rows", "source_size", "target", "_certain", "_p", *more)
    joined = _met(sized, cells, "_cell", rows, "_rows", few).drop("_rows", "_cell", "_class", "_source")
    u = unit_hash(F.col("_id").cast("string"), seed=seed)
    odds = F.log(u) - F.log(1 - u) - (F.log("_p") - F.log(1 - F.col("_p")))
    z = F.when(F.col("_p") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1 - 2.0**-40), (odds + RANGE) / (2 * RANGE))))
    joined = joined.withColumn("_z", z)
    return joined.withColumns({d: F.floor(F.col("_z") * SLOTS**i) % SLOTS for i, d in enumerate(DIGITS, 1)})


def _planned(sized: DataFrame, weights, budget, max_repeat, seed) -> tuple[DataFrame, DataFrame, int, bool]:
    """The allocation of each cell with the cut of its source, and what is taken of the documents that lie on a cut; the rows, and whether cells are few."""
    rows = sized.count()
    cells = materialise(_allocation(sized, weights, budget, max_repeat), "mix-plan")
    few = cells.count() <= FEW_CELLS
    ranked = _ranked(sized, cells, rows, few, seed).filter("_z is not null").select("_key", "_source_rows", "_id", "_size", "_z", *DIGITS)
    ranked = materialise(ranked, "mix-ranked")
    sources = cells.select("_key", "_rest", "_source_rows").distinct()
    cuts, inside = sources, ranked
    for slot in DIGITS:
        cut = _cut(inside, slot, cuts.select("_key", "_rest"))
        cuts = materialise(cuts.drop("_rest").join(cut, "_key", "left").withColumnRenamed("_slot", f"_cut{slot}").withColumnRenamed("_left", "_rest"), "mix-cuts")
        close = cuts.filter(F.col("_rest").isNotNull()).select("_key", F.col(f"_cut{slot}").alias("_at"), "_source_rows")
        inside = _met(inside.drop("_source_rows"), close, "_key", rows, "_source_rows", few).filter(F.col(slot) == F.col("_at")).drop("_at")
    # rows of one id and size share their rank, so they are counted first; within the cut, in order, as many are taken as bring the sum nearest
    edge = inside.join(cuts.select("_key", "_rest"), "_key").groupBy("_key", "_rest", "_z", "_id", "_size").agg(F.count(F.lit(1)).alias("_many"))
    order = Window.partitionBy("_key").orderBy("_z", F.col("_id").cast("string"), "_size").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_sum", F.coalesce(F.sum(F.col("_size") * F.col("_many")).over(order), F.lit(0)))
    take = F.greatest(F.lit(0), F.least(F.col("_many"), F.floor((F.col("_rest") - F.col("_sum")) / F.col("_size") + 0.5)))
    edge = materialise(edge.select("_key", "_id", "_size", "_many", take.cast("long").alias("_take")), "mix-edge")
    return materialise(cells.join(cuts.select("_key", *CUTS), "_key"), "mix-plan"), edge, rows, few


def _decided(sized: DataFrame, plan: tuple[DataFrame, DataFrame, int, bool], seed: int) -> tuple[DataFrame, DataFrame]:
    """sized with _copies, but for the documents on a cut; and those, undecided. Rows of large sources stay where they are."""
    cells, _, rows, few = plan
    placed = _ranked(sized, cells, rows, few, seed, *CUTS)
    at, below = F.lit(True), F.lit(False)
    for slot in DIGITS:
        below = below | (at & F.coalesce(F.col(slot) < F.col(f"_cut{slot}"), F.lit(False)))
        at = at & F.coalesce(F.col(slot) == F.col(f"_cut{slot}"), F.lit(False))
    placed = placed.withColumn("_on_cut", at & F.col("_z").isNotNull()).withColumn("_copies", F.col("_certain") + F.when(below & F.col("_z").isNotNull(), 1).otherwise(0))
    placed = placed.drop("_z", *DIGITS, *CUTS, "_source_rows", "_p")
    return placed.filter(~F.col("_on_cut")), placed.filter("_on_cut")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, max_repeat: float = 2.0, seed: int = 7) -> DataFrame:
    """A row per row of docs: id, size, source_size, target and copies, the times the mix repeats the document."""
    sized = materialise(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    plan = _planned(sized, weights, budget, max_repeat, seed)
    clear, on_cut = _decided(sized, plan, seed)
    on_cut = on_cut.groupBy("_key", "_id", "_size", "source_size", "target", "_certain").agg(F.count(F.lit(1)).alias("_same"))
    same = F.col("a._key").eqNullSafe(F.col("b._key")) & F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._size") == F.col("b._size"))
    on_cut = on_cut.alias("a").join(plan[1].alias("b"), same).select("a.*", "b._take").withColumn("_nth", F.explode(F.expr("sequence(1L, _same)")))
    on_cut = on_cut.withColumn("_copies", F.col("_certain") + F.when(F.col("_nth") <= F.col("_take"), 1).otherwise(0))
    columns = F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", F.col("_copies").cast("long").alias("copies")
    return clear.select(*columns).unionByName(on_cut.select(*columns))


def _cut(ranked: DataFrame, slot: str, need: DataFrame) -> DataFrame:
    """The slot of each key in which the sum of sizes passes _rest, and how much of _rest is left there."""
    sums = ranked.groupBy("_key", F.col(slot).alias("_slot")).agg(F.sum("_size").alias("_words"))
    before = Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    found = sums.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0))).join(need, "_key")
    last = F.max("_slot").over(Window.partitionBy("_key"))
    passed = (F.col("_before") <= F.col("_rest")) & ((F.col("_rest") < F.col("_before") + F.col("_words")) | (F.col("_slot") == F.col("_last")))
    return found.withColumn("_last", last).filter(passed).select("_key", "_slot", (F.col("_rest") - F.col("_before")).alias("_left"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, max_repeat: float = 2.0, seed: int = 7) -> DataFrame:
    """The rows of docs as often as the mix repeats them, with their columns. Texts of large sources do not shuffle."""
    sized = materialise(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    plan = _planned(sized, weights, budget, max_repeat, seed)
    clear, on_cut = _decided(_sized(docs, id_col, text_col, source_col, F.struct("*").alias("_row")), plan, seed)
    same = F.col("a._key").eqNullSafe(F.col("b._key")) & F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._size") == F.col("b._size"))
    # written first, as the plan of both parts at once fills the driver
    on_cut = materialise(on_cut.alias("a").join(plan[1].alias("b"), same).select("a.*", "b._take", "b._many"), "mix-on-cut")
    # of rows that repeat an id and a size, on the cut of a source, the first in order are taken
    nth = F.row_number().over(Window.partitionBy("_key", "_id", "_size").orderBy(F.xxhash64("_row")))
    taken = F.when(F.col("_take") == F.col("_many"), 1).when(F.col("_take") == 0, 0)
    parted = on_cut.filter((F.col("_take") > 0) & (F.col("_take") < F.col("_many"))).withColumn("_more", F.when(nth <= F.col("_take"), 1).otherwise(0))
    whole = on_cut.filter((F.col("_take") == 0) | (F.col("_take") == F.col("_many"))).withColumn("_more", taken)
    on_cut = whole.unionByName(parted).select("_row", (F.col("_certain") + F.col("_more")).alias("_copies"))
    found = clear.select("_row", "_copies").unionByName(on_cut).filter("_copies > 0")
    return found.select("_row", F.explode(F.expr("sequence(1L, cast(_copies as bigint))"))).select("_row.*")
