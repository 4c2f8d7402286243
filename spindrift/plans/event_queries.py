"""Queries over event trains and cluster tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import robust, scalar
from ..operators import curation, relational, trains
from . import views as v
from .registry import query


@query(
    "robust_threshold_events",
    f"""WITH {v.TRAIN}, m AS (SELECT channel, median(extremum_amplitude) AS med FROM train GROUP BY 1),
    d AS (SELECT t.channel, any_value(med) AS med, median(abs(extremum_amplitude - med)) * 1.4826 AS mad FROM train t JOIN m USING (channel) GROUP BY 1)
    SELECT channel, count(*) AS n_events, round(max((extremum_amplitude - med) / mad), 6) AS max_z FROM train JOIN d USING (channel) WHERE abs((extremum_amplitude - med) / mad) > 1.0 GROUP BY 1""",
)
def robust_threshold_events(spark, d):
    t = v.train(spark, d).select("channel", "extremum_amplitude")
    z = robust.robust_z(t, ["channel"], "extremum_amplitude", robust.median_mad(t, ["channel"], "extremum_amplitude"))
    out = z.filter(F.abs("z") > 1.0).groupBy("channel").agg(F.count(F.lit(1)).alias("n_events"), F.max("z").alias("max_z"))
    return v.round_all(out, "max_z")


@query(
    "A01_median_mad",
    f"""WITH {v.TRAIN}, m AS (SELECT channel, median(extremum_amplitude) AS med FROM train GROUP BY 1)
    SELECT channel, round(any_value(med), 6) AS median, round(median(abs(extremum_amplitude - med)) * 1.4826, 6) AS mad FROM train JOIN m USING (channel) GROUP BY 1""",
)
def a01(spark, d):
    return v.round_all(robust.median_mad(v.train(spark, d), ["channel"], "extremum_amplitude"), "median", "mad")


@query("A02_counts", f"WITH {v.TRAIN} SELECT segment, cluster_label, count(*) AS n FROM train GROUP BY ALL")
def a02(spark, d):
    return trains.counts(v.train(spark, d), "segment", "cluster_label")


@query("A03_percentiles", f"WITH {v.TRAIN} SELECT channel, round(quantile_cont(abs(extremum_amplitude), 0.9), 6) AS p90, round(quantile_cont(extremum_amplitude, 0.1), 6) AS p10 FROM train GROUP BY 1")
def a03(spark, d):
    t = v.train(spark, d).groupBy("channel").agg(F.percentile(F.abs("extremum_amplitude"), 0.9).alias("p90"), F.percentile("extremum_amplitude", 0.1).alias("p10"))
    return v.round_all(t, "p90", "p10")


@query(
    "A04_isi_histogram",
    f"""WITH {v.TRAIN}, g AS (SELECT cluster_label, "index" - lag("index") OVER (PARTITION BY segment, cluster_label ORDER BY "index", peak_id) AS gap FROM train)
    SELECT cluster_label, least(CAST(floor(gap / 600.0) AS BIGINT), 11) AS bin, count(*) AS n FROM g WHERE gap BETWEEN 0 AND 7200 GROUP BY ALL""",
)
def a04(spark, d):
    return trains.interval_histogram(v.train(spark, d), "index", "cluster_label", "segment", "peak_id", 1000.0, 0.0, 7200.0, 600.0)


@query("A14_distinct", f"WITH {v.TRAIN} SELECT DISTINCT segment, channel FROM train")
def a14(spark, d):
    return v.train(spark, d).select("segment", "channel").distinct()


_PAIRS = f"""WITH {v.TRAIN}, p AS (SELECT a.cluster_label AS label_i, b.cluster_label AS label_j, (b."index" - a."index") // 600 AS bin FROM train a JOIN train b ON a.segment = b.segment
    AND b."index" BETWEEN a."index" AND a."index" + 4199 AND (b."index" > a."index" OR b.peak_id > a.peak_id)), c AS (SELECT label_i, label_j, bin, count(*) AS n FROM p WHERE bin <> 0 OR label_i <> label_j GROUP BY ALL),
    l AS (SELECT DISTINCT cluster_label AS x FROM train)"""


@query("C05_cross_correlograms", _PAIRS + ' SELECT i.x AS label_i, j.x AS label_j, b AS bin, coalesce(n, 0) AS "count" FROM l i, l j, range(0, 7) r(b) LEFT JOIN c ON c.label_i = i.x AND c.label_j = j.x AND c.bin = b')
def c05(spark, d):
    return trains.cross_correlograms(v.train(spark, d), "index", "cluster_label", "segment", "peak_id", 1.0, 7200.0, 600.0)


@query(
    "C05_symmetrized",
    _PAIRS
    + """, s AS (SELECT label_i, label_j, bin, max(n) AS n FROM (SELECT * FROM c UNION ALL SELECT label_j, label_i, -bin, n FROM c) GROUP BY ALL)
    SELECT i.x AS label_i, j.x AS label_j, b AS bin, coalesce(n, 0) AS "count" FROM l i, l j, range(-6, 7) r(b) LEFT JOIN s ON s.label_i = i.x AND s.label_j = j.x AND s.bin = b""",
)
def c05s(spark, d):
    return trains.cross_correlograms(v.train(spark, d), "index", "cluster_label", "segment", "peak_id", 1.0, 7200.0, 600.0, symmetrize=True)


@query("C06_lag_lead", f'WITH {v.TRAIN} SELECT peak_id, "index" - lag("index") OVER w AS before, lead("index") OVER w - "index" AS after FROM train WINDOW w AS (PARTITION BY segment, channel ORDER BY "index", peak_id)')
def c06(spark, d):
    w = Window.partitionBy("segment", "channel").orderBy("index", "peak_id")
    return v.train(spark, d).select("peak_id", (F.col("index") - F.lag("index").over(w)).alias("before"), (F.lead("index").over(w) - F.col("index")).alias("after"))


@query(
    "C07_durations",
    f"""WITH {v.TRAIN}, s AS (SELECT channel, count(*) AS length FROM train GROUP BY 1)
    SELECT channel, length, CAST(greatest(0, least(length, 5000 - coalesce(sum(length) OVER (ORDER BY channel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS duration FROM s""",
)
def c07(spark, d):
    s = v.train(spark, d).groupBy("channel").agg(F.count(F.lit(1)).alias("length"))
    return robust.durations_per_segment(s, "channel", "length", 5000).withColumn("duration", F.col("duration").cast("long"))


@query("C08_sorted_peaks", f"WITH {v.TRAIN} SELECT peak_id, extremum_amplitude FROM train ORDER BY abs(extremum_amplitude) DESC, peak_id")
def c08(spark, d):
    return v.train(spark, d).orderBy(F.desc(F.abs("extremum_amplitude")), "peak_id").select("peak_id", "extremum_amplitude")


_HASH = "((peak_id % 2147483648 + 0) * 2654435761) % 4294967296"


@query("C09_top_n_per_channel", f"WITH {v.TRAIN}, r AS (SELECT peak_id, channel, row_number() OVER (PARTITION BY channel ORDER BY {_HASH}, peak_id) AS r FROM train) SELECT peak_id, channel FROM r WHERE r <= 20")
def c09(spark, d):
    return relational.sample_per_key(v.train(spark, d).select("peak_id", "channel"), ["channel"], "peak_id", 20)


@query("C10_union_all", f"WITH {v.TRAIN} SELECT peak_id, segment FROM train WHERE segment = 0 UNION ALL SELECT peak_id, segment FROM train WHERE channel < 3")
def c10(spark, d):
    t = v.train(spark, d).select("peak_id", "segment", "channel")
    return relational.union_all(t.filter("segment = 0"), t.filter("channel < 3")).select("peak_id", "segment")


@query("C11_label_pairs", "SELECT a.n_nationkey::BIGINT AS label_i, b.n_nationkey::BIGINT AS label_j FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def c11(spark, d):
    from ..operators.metrics import pair_list

    return pair_list(v.clusters(spark, d), "cluster_label")


@query(
    "C12_channel_set_operations",
    f"""WITH {v.TRAIN}, s AS (SELECT segment, list_sort(list(DISTINCT channel)) AS c FROM train WHERE cluster_label < 3 GROUP BY 1), u AS (SELECT segment, list_sort(list(DISTINCT channel)) AS c FROM train WHERE cluster_label > 1 GROUP BY 1)
    SELECT s.segment, len(list_intersect(s.c, u.c))::INT AS both, len(list_distinct(list_concat(s.c, u.c)))::INT AS either, len(list_filter(s.c, lambda x: NOT list_contains(u.c, x)))::INT AS only_first FROM s JOIN u USING (segment)""",
)
def c12(spark, d):
    t = v.train(spark, d)
    s = t.filter("cluster_label < 3").groupBy("segment").agg(F.collect_set("channel").alias("c"))
    u = t.filter("cluster_label > 1").groupBy("segment").agg(F.collect_set("channel").alias("e"))
    return s.join(u, "segment").select("segment", F.size(F.array_intersect("c", "e")).alias("both"), F.size(F.array_union("c", "e")).alias("either"), F.size(F.array_except("c", "e")).alias("only_first"))


@query("F01_sample_peaks", f"WITH {v.TRAIN} SELECT peak_id, cluster_label FROM train ORDER BY {_HASH}, peak_id LIMIT 500")
def f01(spark, d):
    return relational.sample_total(v.train(spark, d), "peak_id", 500).select("peak_id", "cluster_label")


@query(
    "F01_sampler_labels",
    f"""WITH {v.TRAIN}, s AS (SELECT peak_id FROM train ORDER BY {_HASH}, peak_id LIMIT 500)
    SELECT peak_id, CASE WHEN extremum_amplitude <= -240 THEN -9 WHEN s.peak_id IS NOT NULL THEN 0 ELSE -11 END::BIGINT AS cluster_label FROM train LEFT JOIN s USING (peak_id)""",
)
def f01b(spark, d):
    t = trains.mark_aliens(v.train(spark, d), "extremum_amplitude", "cluster_label", 240.0)
    return curation.sampler_labels(t, relational.sample_total(v.train(spark, d), "peak_id", 500)).select("peak_id", "cluster_label")


@query("J02_cell_labels", f"WITH {v.TRAIN}, {v.CLUSTERS} SELECT peak_id, coalesce(cell_label, t.cluster_label) AS cluster_label FROM (SELECT * REPLACE (cluster_label - 2 AS cluster_label) FROM train) t LEFT JOIN clusters c USING (cluster_label)")
def j02(spark, d):
    t = v.train(spark, d).withColumn("cluster_label", F.col("cluster_label") - 2)
    return trains.relabel_to_cells(t, v.clusters(spark, d)).select("peak_id", "cluster_label")


@query("J03_extremum_channels", f"WITH {v.TRAIN}, {v.CLUSTERS} SELECT peak_id, extremum_channel FROM train JOIN clusters USING (cluster_label)")
def j03(spark, d):
    return v.train(spark, d).join(v.clusters(spark, d), "cluster_label").select("peak_id", "extremum_channel")


@query(
    "J04_cluster_attributes",
    f"""WITH {v.TRAIN}, {v.CLUSTERS} SELECT cluster_label, nb_peak, coalesce(cell_label, cluster_label) AS cell_label, extremum_channel FROM (SELECT cluster_label, count(*) AS nb_peak FROM train GROUP BY 1) LEFT JOIN clusters USING (cluster_label)""",
)
def j04(spark, d):
    return curation.rebuild_clusters(v.train(spark, d).select("cluster_label"), v.clusters(spark, d)).select("cluster_label", "nb_peak", "cell_label", "extremum_channel")


@query(
    "J01_range_join_orders",
    """SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey % 64 = o_orderkey % 64 AND epoch_us(l_shipdate) // 86400000000 BETWEEN epoch_us(o_orderdate) // 86400000000 AND epoch_us(o_orderdate) // 86400000000 + 3 GROUP BY 1""",
)
def j01_orders(spark, d):
    day = "timestampdiff(DAY, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({} as timestamp_ntz))"
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 64).alias("_k"), F.expr(day.format("o_orderdate")).alias("_o"))
    li = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 64).alias("_k"), F.expr(day.format("l_shipdate")).alias("_s"))
    return relational.range_join(o, li, F.col("_o"), F.col("_o") + 3, F.col("_s"), 4, ["_k"]).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "J08_noise_anti_join",
    f"""WITH {v.TRAIN} SELECT a.peak_id FROM train a WHERE a.cluster_label = 5 AND NOT EXISTS (SELECT 1 FROM train b WHERE b.cluster_label < 3 AND b.segment = a.segment AND a."index" BETWEEN b."index" - 120 AND b."index" + 180)""",
)
def j08(spark, d):
    t = v.train(spark, d).select("peak_id", "segment", "index", "cluster_label")
    peaks = t.filter("cluster_label < 3").select("segment", F.col("index").alias("_p"))
    return relational.uncovered(t.filter("cluster_label = 5"), peaks, "index", F.col("_p") - 120, F.col("_p") + 180, 512, ["segment"]).select("peak_id")


@query("J09_semi_join_channels", f"WITH {v.TRAIN} SELECT peak_id FROM train WHERE channel IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def j09(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("channel"))
    return v.train(spark, d).join(n, "channel", "left_semi").select("peak_id")


@query(
    "J11_suppressed_peaks",
    f"""WITH {v.TRAIN} SELECT a.peak_id FROM train a WHERE cluster_label >= 3 AND NOT EXISTS (SELECT 1 FROM train b WHERE b.cluster_label = 0 AND b.segment = a.segment AND abs(b.channel - a.channel) <= 1 AND a."index" > b."index" - 900 AND a."index" < b."index" + 1500)""",
)
def j11(spark, d):
    t = v.train(spark, d).select("peak_id", "segment", "index", "channel", "cluster_label")
    accepted = t.filter("cluster_label = 0").select("segment", F.col("index").alias("_i"), F.explode(F.sequence(F.col("channel") - 1, F.col("channel") + 1)).alias("channel"))
    near = relational.range_join(accepted, t.filter("cluster_label >= 3"), F.col("_i") - 899, F.col("_i") + 1499, F.col("index"), 2400, ["segment", "channel"])
    return t.filter("cluster_label >= 3").join(near.select("peak_id").distinct(), "peak_id", "left_anti").select("peak_id")


@query("K18_trash_low", f"WITH {v.TRAIN}, {v.CLUSTERS} SELECT peak_id, CASE WHEN abs(c.extremum_amplitude) < 5.5 THEN -1 ELSE t.cluster_label END AS cluster_label FROM train t LEFT JOIN clusters c USING (cluster_label)")
def k18(spark, d):
    return curation.trash_low(v.train(spark, d), v.clusters(spark, d).select("cluster_label", "extremum_amplitude"), 5.5).select("peak_id", "cluster_label")


@query(
    "K19_trash_small",
    f"""WITH {v.TRAIN}, s AS (SELECT * REPLACE (peak_id % 997 AS cluster_label) FROM train), n AS (SELECT cluster_label, count(*) AS n FROM s GROUP BY 1)
    SELECT peak_id, CASE WHEN n <= 10 THEN -1 ELSE s.cluster_label END AS cluster_label FROM s JOIN n USING (cluster_label)""",
)
def k19(spark, d):
    t = v.train(spark, d).withColumn("cluster_label", F.col("peak_id") % 997)
    return curation.trash_small(t, 10).select("peak_id", "cluster_label")


@query(
    "K20_merge_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey::BIGINT AS a, (n_nationkey * 3 % 25)::BIGINT AS b FROM nation WHERE n_nationkey % 4 = 1 AND n_nationkey <> n_nationkey * 3 % 25), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(x, y) AS (SELECT a, a FROM s UNION SELECT r.x, s.b FROM r JOIN s ON r.y = s.a) SELECT x AS "old", min(y) AS "new" FROM r GROUP BY 1 HAVING min(y) <> x""",
)
def k20(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").filter("n_nationkey % 4 = 1 and n_nationkey <> n_nationkey * 3 % 25")
    curation.ensure_checkpoint_dir(spark)
    return curation.merge_pairs(n.select(F.col("n_nationkey").cast("long").alias("label_i"), (F.col("n_nationkey") * 3 % 25).cast("long").alias("label_j")))


@query("K21_merge_labels", f"WITH {v.TRAIN} SELECT peak_id, CASE WHEN cluster_label IN (1, 3, 5) THEN 1 ELSE cluster_label END AS cluster_label FROM train")
def k21(spark, d):
    return curation.merge(v.train(spark, d), [5, 3, 1]).select("peak_id", "cluster_label")


@query("K21_split_off", f"WITH {v.TRAIN} SELECT peak_id, CASE WHEN channel = 2 AND extremum_amplitude > 0 THEN 6 ELSE cluster_label END AS cluster_label FROM train")
def k21b(spark, d):
    t = v.train(spark, d)
    return curation.set_label(t, t.filter("channel = 2 and extremum_amplitude > 0"), curation.new_label(t)).select("peak_id", "cluster_label")


@query("K21_same_cell", f"WITH {v.CLUSTERS} SELECT cluster_label, CASE WHEN cluster_label IN (4, 7, 9) THEN 4 ELSE cell_label END AS cell_label FROM clusters")
def k21c(spark, d):
    return curation.tag_same_cell(v.clusters(spark, d), [9, 4, 7]).select("cluster_label", "cell_label")


@query("K22_cluster_rows", f"WITH {v.TRAIN} SELECT cluster_label, count(*) AS nb_peak FROM train GROUP BY 1")
def k22(spark, d):
    return curation.label_sizes(v.train(spark, d))


@query(
    "K23_order_clusters",
    f"""WITH {v.CLUSTERS}, r AS (SELECT cluster_label, cell_label, row_number() OVER (ORDER BY abs(waveform_rms) DESC, cluster_label) - 1 AS new_label FROM clusters)
    SELECT cluster_label, new_label, min(new_label) OVER (PARTITION BY cell_label) AS new_cell FROM r""",
)
def k23(spark, d):
    return curation.order_clusters(v.clusters(spark, d)).select("cluster_label", "new_label", "new_cell")


@query("P05_aliens", f"WITH {v.TRAIN} SELECT peak_id, CASE WHEN extremum_amplitude <= -200 THEN -9 ELSE cluster_label END AS cluster_label FROM train")
def p05(spark, d):
    return trains.mark_aliens(v.train(spark, d), "extremum_amplitude", "cluster_label", 200.0).select("peak_id", "cluster_label")


@query("P06_borders", f'WITH {v.TRAIN}, l AS (SELECT segment, max("index") AS length FROM train GROUP BY 1) SELECT peak_id FROM train JOIN l USING (segment) WHERE "index" > 1704200000 AND "index" < length - 1704200000 + 1704153600')
def p06(spark, d):
    t = v.train(spark, d)
    lengths = t.groupBy("segment").agg((F.max("index")).alias("length"))
    shifted = t.withColumn("index", F.col("index") - 1704153600)
    shortened = lengths.withColumn("length", F.col("length") - 1704153600)
    return trains.inside_borders(shifted, "index", "segment", 46400, shortened).select("peak_id")


@query("P07_visible", f"WITH {v.TRAIN} SELECT peak_id FROM train WHERE cluster_label IN (1, 4)")
def p07(spark, d):
    return v.train(spark, d).filter(F.col("cluster_label").isin(1, 4)).select("peak_id")


@query(
    "P08_collisions",
    f"""WITH {v.TRAIN}, g AS (SELECT peak_id, "index" - lag("index") OVER w AS a, lead("index") OVER w - "index" AS b FROM train WHERE cluster_label >= 0 WINDOW w AS (PARTITION BY segment ORDER BY "index", peak_id))
    SELECT peak_id FROM g WHERE a < 60 OR b < 60""",
)
def p08(spark, d):
    return trains.collisions(v.train(spark, d), "index", "cluster_label", "segment", "peak_id", 60).select("peak_id")


@query("P09_seek", f'WITH {v.TRAIN} SELECT peak_id, "index" - 1704500000 AS "index" FROM train WHERE "index" >= 1704500000 AND "index" < 1704900000')
def p09(spark, d):
    return trains.seek(v.train(spark, d), "index", 1704500000, 1704900000).select("peak_id", "index")


@query(
    "P12_lasso",
    f"""WITH {v.TRAIN}, t AS (SELECT peak_id, channel::DOUBLE AS x, extremum_amplitude AS y FROM train),
    c AS (SELECT peak_id, ((0 > y) <> (200 > y) AND x < 1 + (y - 0) * (4.0 / 200))::INT + ((200 > y) <> (-100 > y) AND x < 5 + (y - 200) * (7.0 / -300))::INT + ((-100 > y) <> (0 > y) AND x < 12 + (y + 100) * (-11.0 / 100))::INT AS k FROM t)
    SELECT peak_id FROM c WHERE k % 2 = 1""",
)
def p12(spark, d):
    inside = scalar.inside_polygon(F.col("channel").cast("double"), F.col("extremum_amplitude"), [(1.0, 0.0), (5.0, 200.0), (12.0, -100.0)])
    return v.train(spark, d).filter(inside).select("peak_id")


@query("P13_nearest", f"WITH {v.TRAIN} SELECT peak_id, round((channel - 3.3) * (channel - 3.3) + (extremum_amplitude - 20.5) * (extremum_amplitude - 20.5), 6) AS distance2 FROM train ORDER BY (channel - 3.3) * (channel - 3.3) + (extremum_amplitude - 20.5) * (extremum_amplitude - 20.5), peak_id LIMIT 1")
def p13(spark, d):
    from ..operators.metrics import nearest

    return v.round_all(nearest(v.train(spark, d), F.col("channel").cast("double"), F.col("extremum_amplitude"), (3.3, 20.5), "peak_id").select("peak_id", "distance2"), "distance2")


@query(
    "P15_rgba",
    "SELECT event_id, (user_id % 256 * 16777216 + event_id % 256 * 65536 + 17 * 256 + 255)::BIGINT AS packed, (user_id % 256)::BIGINT AS r, (event_id % 256)::BIGINT AS g, 17::BIGINT AS b, 255::BIGINT AS a FROM events",
)
def p15(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    packed = e.select("event_id", scalar.pack_rgba(F.col("user_id") % 256, F.col("event_id") % 256, F.lit(17), F.lit(255)).alias("packed"))
    return packed.select("event_id", "packed", scalar.unpack_rgba(F.col("packed")).alias("c")).select("event_id", "packed", "c.r", "c.g", "c.b", "c.a")


@query("P16_units", f"WITH {v.TRAIN} SELECT peak_id, CAST(trunc(extremum_amplitude / 1000.0 * 15000.0) AS BIGINT) AS samples, round(\"index\" / 15000.0, 6) AS seconds, round(extremum_amplitude * 2.5 * 0.195, 6) AS uv FROM train")
def p16(spark, d):
    t = v.train(spark, d)
    out = t.select("peak_id", scalar.ms_to_samples(F.col("extremum_amplitude"), 15000).alias("samples"), scalar.samples_to_seconds(F.col("index"), 15000).alias("seconds"), scalar.mad_to_microvolt(F.col("extremum_amplitude"), F.lit(2.5), 0.195).alias("uv"))
    return v.round_all(out, "seconds", "uv")


@query("S10_point_lookup", f"WITH {v.SIGNAL}, p AS (SELECT event_id AS peak_id, CAST(event_id // 4096 AS INT) AS segment, (event_id % 512) AS sample, CAST(user_id % 8 AS INT) AS channel FROM events) SELECT peak_id, round(value, 6) AS value FROM p JOIN signal USING (segment, sample, channel)")
def s10(spark, d):
    i = F.col("event_id")
    p = spark.read.parquet(f"{d}/events.parquet").select(i.alias("peak_id"), F.floor(i / 4096).cast("int").alias("segment"), (i % 512).alias("sample"), (F.col("user_id") % 8).cast("int").alias("channel"))
    return v.round_all(p.join(v.signal(spark, d), ["segment", "sample", "channel"]).select("peak_id", "value"), "value")


@query("S17_export_rows", f'WITH {v.TRAIN} SELECT segment, "index", cluster_label AS label FROM train WHERE cluster_label >= 0')
def s17(spark, d):
    from ..sources.export import export_rows

    return export_rows(v.train(spark, d)).select("segment", "index", "label")


@query("G01_peak_list", f'WITH {v.TRAIN} SELECT peak_id, segment, round("index" / 15000.0, 6) AS "time", cluster_label, channel, round(extremum_amplitude, 6) AS extremum_amplitude FROM train WHERE cluster_label IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)')
def g01(spark, d):
    shown = spark.read.parquet(f"{d}/nation.parquet").filter("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("cluster_label"))
    return v.round_all(trains.peak_rows(v.train(spark, d), 15000.0, shown), "time", "extremum_amplitude")


@query("G02_spike_list", f"WITH {v.TRAIN} SELECT peak_id, round((\"index\" + CASE WHEN peak_id % 3 = 0 THEN 0 ELSE 0.25 END) / 10000.0, 6) AS \"time\" FROM train")
def g02(spark, d):
    jitter = F.when(F.col("peak_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(0.25))
    return v.round_all(v.train(spark, d).select("peak_id", scalar.spike_time(F.col("index"), jitter, 10000.0).alias("time")), "time")


@query("G03_cluster_list", f"WITH {v.CLUSTERS} SELECT cluster_label, row_number() OVER (ORDER BY cluster_label >= 0, extremum_amplitude DESC, cluster_label) AS position FROM (SELECT * REPLACE (cluster_label - 3 AS cluster_label) FROM clusters)")
def g03(spark, d):
    c = v.clusters(spark, d).withColumn("cluster_label", F.col("cluster_label") - 3)
    order = Window.orderBy(F.col("cluster_label") >= 0, F.desc("extremum_amplitude"), "cluster_label")
    return c.select("cluster_label", F.row_number().over(order).cast("long").alias("position"))


@query("G06_feature_vs_time", f'WITH {v.TRAIN} SELECT peak_id, round("index" / 15000.0, 6) AS "time", (channel * 50.0)::DOUBLE AS y FROM train WHERE channel < 8')
def g06(spark, d):
    out = v.train(spark, d).join(F.broadcast(v.probe(spark).select("channel", "y")), "channel").select("peak_id", (F.col("index") / 15000.0).alias("time"), "y")
    return v.round_all(out, "time")


@query(
    "R04_sliding_rates",
    """SELECT w AS window_start, channel, count(*) AS n FROM (SELECT epoch_us(ts) // 1000000 AS t, CAST(user_id % 16 AS INT) AS channel FROM events), (SELECT unnest(range(0, 4)) AS k), LATERAL (SELECT (t // 3600 - k) * 3600 AS w) GROUP BY ALL""",
)
def r04(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("ts", (F.col("user_id") % 16).cast("int").alias("channel"))
    out = trains.rates(e, "ts", "4 hours", "1 hour", "channel")
    return out.select(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(window.start as timestamp_ntz))").alias("window_start"), "channel", "n")


@query("P17_colours")
def p17(spark, d):
    c = v.clusters(spark, d)
    n = c.count()
    return c.select("cluster_label", scalar.hue_colour(F.col("cluster_label"), F.lit(n)).alias("color"))


@query("J10_probe_coordinates", f"WITH {v.TRAIN} SELECT peak_id, (channel * 50.0)::DOUBLE AS y FROM train WHERE channel < 8")
def j10(spark, d):
    return v.train(spark, d).join(F.broadcast(v.probe(spark).select("channel", "y")), "channel").select("peak_id", "y")


@query("J12_static_stream_join", f"WITH {v.TRAIN}, {v.CLUSTERS} SELECT cell_label, count(*) AS n FROM train JOIN clusters USING (cluster_label) GROUP BY 1")
def j12(spark, d):
    return v.train(spark, d).join(F.broadcast(v.clusters(spark, d).select("cluster_label", "cell_label")), "cluster_label").groupBy("cell_label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "C05_chosen_labels",
    f"""WITH {v.TRAIN}, t AS (SELECT * FROM train WHERE cluster_label IN (0, 2)) SELECT a.cluster_label AS label_i, b.cluster_label AS label_j, (b."index" - a."index") // 300 AS bin, count(*) AS "count" FROM t a JOIN t b ON a.segment = b.segment
    AND b."index" BETWEEN a."index" AND a."index" + 2099 AND (b."index" > a."index" OR b.peak_id > a.peak_id) WHERE (b."index" - a."index") // 300 <> 0 OR a.cluster_label <> b.cluster_label GROUP BY ALL""",
)
def c05l(spark, d):
    chosen = spark.createDataFrame([(0,), (2,)], "cluster_label long")
    return trains.cross_correlograms(v.train(spark, d), "index", "cluster_label", "segment", "peak_id", 1.0, 3600.0, 300.0, labels=chosen, dense=False)


@query("S12_segments_done", f'WITH {v.TRAIN} SELECT segment, max("index") + 1 AS processed_length FROM train GROUP BY 1')
def s12t(spark, d):
    from ..sources.store import processed_length

    return processed_length(v.train(spark, d).withColumnRenamed("index", "sample"))


@query("S24_imported_units")
def s24(spark, d):
    from ..sources import importers

    t = v.train(spark, d).select((F.col("peak_id") * 37 % 4096).alias("t"), (F.col("cluster_label") % 3).alias("unit"), F.floor(F.col("peak_id") / 4096).alias("s"))
    spikes = importers.from_spike_table(t.withColumn("t", F.floor(F.col("t") / 9)), "unit", "t", segment="s")
    return importers.align_units(spikes, v.signal(spark, d), -3, 4).select("segment", "index", "channel", F.round("extremum_amplitude", 6).alias("extremum_amplitude"), "cluster_label")
