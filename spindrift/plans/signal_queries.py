"""Queries over signals in long form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, robust
from ..operators import detect, relational
from . import views as v
from .registry import query


@query("W07_common_reference", f"WITH {v.SIGNAL} SELECT segment, sample, channel, round(value - median(value) OVER (PARTITION BY segment, sample), 6) AS value FROM signal")
def w07(spark, d):
    out = robust.common_reference(v.signal(spark, d), "value", ["segment", "sample"], "cmr")
    return out.select("segment", "sample", "channel", F.round("cmr", 6).alias("value"))


@query(
    "W08_noise_estimate",
    f"""WITH {v.SIGNAL}, h AS (SELECT * FROM signal WHERE sample < 448 AND segment = 0), m AS (SELECT channel, median(value) AS med FROM h GROUP BY 1)
    SELECT channel, round(any_value(med), 6) AS median, round(median(abs(value - med)) * 1.4826, 6) AS mad FROM h JOIN m USING (channel) GROUP BY 1""",
)
def w08(spark, d):
    out = robust.noise_from_head(v.signal(spark, d), "channel", "value", "sample", 100.0, 5.0, 64, F.col("segment") == 0)
    return v.round_all(out, "median", "mad")


@query(
    "W09_normalised",
    f"""WITH {v.SIGNAL}, m AS (SELECT channel, median(value) AS med FROM signal GROUP BY 1), s AS (SELECT channel, any_value(med) AS med, median(abs(value - med)) * 1.4826 AS mad FROM signal JOIN m USING (channel) GROUP BY 1)
    SELECT segment, sample, channel, round((value - med) / mad, 6) AS z FROM signal JOIN s USING (channel)""",
)
def w09(spark, d):
    s = v.signal(spark, d)
    return v.round_all(robust.robust_z(s, ["channel"], "value", robust.median_mad(s, ["channel"], "value")).select("segment", "sample", "channel", "z"), "z")


@query(
    "E01_global_peaks",
    f"""WITH {v.SIGNAL}, r AS (SELECT segment, sample, sum(CASE WHEN value <= -150 THEN value ELSE 0 END) AS x FROM signal GROUP BY ALL),
    w AS (SELECT *, min(x) OVER b AS lo, min(x) OVER a AS hi, count(*) OVER b AS nb, count(*) OVER a AS na FROM r WINDOW b AS (PARTITION BY segment ORDER BY sample ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY segment ORDER BY sample ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))
    SELECT segment, sample, -1 AS channel, 0.0::DOUBLE AS extremum_amplitude FROM w WHERE nb = 4 AND na = 4 AND x < lo AND x <= hi AND x <> 0""",
)
def e01(spark, d):
    return detect.detect_global(v.signal(spark, d), 150.0, 4, "-")


_E02 = """, n AS (SELECT a.c AS c1, b.c AS c2 FROM range(8) a(c), range(8) b(c) WHERE abs(a.c - b.c) * 50.0 <= 60),
    w AS (SELECT *, {f}(value) OVER b AS lo, {f}(value) OVER a AS hi, count(*) OVER b AS nb, count(*) OVER a AS na FROM signal WINDOW b AS (PARTITION BY segment, channel ORDER BY sample ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY segment, channel ORDER BY sample ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
    p AS (SELECT * FROM w WHERE nb = 3 AND na = 3 AND {over})
    SELECT p.segment, p.sample, p.channel, round(p.value, 6) AS extremum_amplitude FROM p JOIN n ON n.c1 = p.channel JOIN w q ON q.segment = p.segment AND q.sample = p.sample AND q.channel = n.c2
    GROUP BY p.segment, p.sample, p.channel, p.value HAVING bool_and({rule})"""


@query("E02_geometrical_peaks", f"WITH {v.SIGNAL}" + _E02.format(f="min", over="value < -100", rule="p.value <= q.value AND p.value < q.lo AND p.value <= q.hi"))
def e02(spark, d):
    near = detect.neighbourhood(v.probe(spark), 60.0)
    return v.round_all(detect.detect_geometrical(v.signal(spark, d), near, 100.0, 3, "-"), "extremum_amplitude")


@query("E02_positive_peaks_in_blocks", f"WITH {v.SIGNAL}" + _E02.format(f="max", over="value > 100", rule="p.value >= q.value AND p.value > q.lo AND p.value >= q.hi"))
def e02p(spark, d):
    near = detect.neighbourhood(v.probe(spark), 60.0)
    return v.round_all(detect.detect_geometrical(v.signal(spark, d), near, 100.0, 3, "+", block=128), "extremum_amplitude")


@query("E05_spatial_kernel", "SELECT a.c::INT AS c1, b.c::INT AS c2, round(CASE WHEN exp(-abs(a.c - b.c) * 50 / 40.0) < 0.01 THEN 0 ELSE exp(-abs(a.c - b.c) * 50 / 40.0) END, 6) AS weight FROM range(8) a(c), range(8) b(c)")
def e05(spark, d):
    return v.round_all(detect.spatial_kernel(detect.channel_distances(v.probe(spark)), 40.0).select("c1", "c2", "weight"), "weight")


@query(
    "E05_smoothed_signal",
    f"""WITH {v.SIGNAL}, k AS (SELECT a.c AS c1, b.c AS c2, exp(-abs(a.c - b.c) * 50 / 40.0) AS w FROM range(8) a(c), range(8) b(c))
    SELECT segment, sample, CAST(c2 AS INT) AS channel, round(sum(value * w), 6) AS value FROM signal JOIN k ON c1 = channel WHERE w >= 0.01 GROUP BY ALL""",
)
def e05s(spark, d):
    kernel = detect.spatial_kernel(detect.channel_distances(v.probe(spark)), 40.0)
    return v.round_all(detect.smooth_over_channels(v.signal(spark, d), kernel), "value")


@query(
    "E06_redetect_counts",
    f"""WITH {v.SIGNAL}, w AS (SELECT *, min(value) OVER b AS lo, min(value) OVER a AS hi, count(*) OVER b AS nb, count(*) OVER a AS na FROM signal WINDOW b AS (PARTITION BY segment, channel ORDER BY sample ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY segment, channel ORDER BY sample ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
    SELECT channel, count(*) AS n FROM w WHERE nb = 5 AND na = 5 AND value < -50 AND value < lo AND value <= hi GROUP BY 1""",
)
def e06(spark, d):
    alone = detect.neighbourhood(v.probe(spark), 10.0)
    return detect.detect_geometrical(v.signal(spark, d), alone, 50.0, 5, "-").groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query("P02_channel_distances", "SELECT 0 AS chan_grp, a.c::INT AS c1, b.c::INT AS c2, abs(a.c - b.c) * 50.0::DOUBLE AS distance FROM range(8) a(c), range(8) b(c)")
def p02(spark, d):
    return detect.channel_distances(v.probe(spark))


@query("P03_adjacency", "SELECT a.c::INT AS c1, b.c::INT AS c2 FROM range(8) a(c), range(8) b(c) WHERE abs(a.c - b.c) * 50 < 100")
def p03(spark, d):
    return detect.neighbourhood(v.probe(spark), 100.0, inclusive=False).select("c1", "c2")


@query("P04_neighbourhood", "SELECT a.c::INT AS c1, b.c::INT AS c2 FROM range(8) a(c), range(8) b(c) WHERE abs(a.c - b.c) * 50 <= 100")
def p04(spark, d):
    return detect.neighbourhood(v.probe(spark), 100.0).select("c1", "c2")


@query("P01_channel_projection", f"WITH {v.SIGNAL} SELECT segment, sample, channel, round(value, 6) AS value FROM signal WHERE channel IN (1, 5)")
def p01(spark, d):
    return v.round_all(v.signal(spark, d).filter(F.col("channel").isin(1, 5)), "value")


@query("S08_chunk_scan", f"WITH {v.SIGNAL} SELECT segment, sample, channel, round(value, 6) AS value FROM signal WHERE segment = 1 AND sample >= 100 AND sample < 228")
def s08(spark, d):
    return v.round_all(v.signal(spark, d).filter("segment = 1 and sample >= 100 and sample < 228"), "value")


@query("S09_chunks", f"WITH {v.SIGNAL} SELECT segment, sample // 100 AS chunk, count(*) AS n, round(sum(value), 4) AS total FROM signal GROUP BY ALL")
def s09(spark, d):
    out = v.signal(spark, d).groupBy("segment", F.floor(F.col("sample") / 100).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out


@query("S09_halo_blocks", f"WITH {v.SIGNAL} SELECT segment, b AS block, count(*) AS n, sum((b = sample // 64)::INT)::BIGINT AS core FROM signal, range(0, 9) r(b) WHERE b BETWEEN floor((sample - 10) / 64.0) AND floor((sample + 10) / 64.0) GROUP BY ALL")
def s09h(spark, d):
    out = relational.with_halo(v.signal(spark, d), "sample", 64, 10)
    return out.groupBy("segment", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("core").cast("long")).alias("core"))


@query("S12_processed_length", f"WITH {v.SIGNAL} SELECT segment, max(sample) + 1 AS processed_length, max(sample) + 1 >= 400 AS done FROM signal GROUP BY 1")
def s12(spark, d):
    return v.signal(spark, d).groupBy("segment").agg((F.max("sample") + 1).alias("processed_length"), (F.max("sample") + 1 >= 400).alias("done"))


@query("G07_trace_scale", f"WITH {v.SIGNAL}, m AS (SELECT channel, median(value) AS med FROM signal WHERE sample < 300 GROUP BY 1) SELECT channel, round(any_value(med), 6) AS \"offset\", round(1 / (15 * median(abs(value - med)) * 1.4826), 9) AS gain FROM signal JOIN m USING (channel) WHERE sample < 300 GROUP BY 1")
def g07(spark, d):
    m = robust.median_mad(v.signal(spark, d).filter("sample < 300"), ["channel"], "value")
    return m.select("channel", F.round("median", 6).alias("offset"), F.round(F.try_divide(F.lit(1.0), 15 * F.col("mad")), 9).alias("gain"))


@query("W07_frames", f"WITH {v.SIGNAL} SELECT segment, sample, round(max(value) - median(value), 6) AS top FROM signal GROUP BY ALL")
def w07f(spark, d):
    frames = v.signal(spark, d).groupBy("segment", "sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda c: c["value"]).alias("v"))
    return frames.select("segment", "sample", F.round(F.array_max(arrays.centred_on_median(F.col("v"))), 6).alias("top"))


@query("R05_noise_bootstrap", f"WITH {v.SIGNAL} SELECT segment, channel, round(median(value), 6) AS median FROM signal WHERE sample < 200 GROUP BY ALL")
def r05(spark, d):
    return v.signal(spark, d).filter("sample < 200").groupBy("segment", "channel").agg(F.round(F.median("value"), 6).alias("median"))


@query("R07_display_window", f"WITH {v.SIGNAL}, m AS (SELECT segment, max(sample) AS last FROM signal GROUP BY 1) SELECT segment, sample, channel, round(value, 6) AS value FROM signal JOIN m USING (segment) WHERE sample > last - 32")
def r07(spark, d):
    s = v.signal(spark, d)
    last = s.groupBy("segment").agg(F.max("sample").alias("_last"))
    return v.round_all(s.join(last, "segment").filter("sample > _last - 32").drop("_last"), "value")


@query("W12_contiguity", f"WITH {v.SIGNAL}, g AS (SELECT segment, sample - lag(sample) OVER (PARTITION BY segment, channel ORDER BY sample) AS step FROM signal) SELECT segment, max(step) AS largest_step, min(step) AS smallest_step FROM g GROUP BY 1")
def w12(spark, d):
    w = Window.partitionBy("segment", "channel").orderBy("sample")
    g = v.signal(spark, d).select("segment", (F.col("sample") - F.lag("sample").over(w)).alias("step"))
    return g.groupBy("segment").agg(F.max("step").alias("largest_step"), F.min("step").alias("smallest_step"))
