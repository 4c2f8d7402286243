"""Queries over waveforms, centroids and similarities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import metrics, trains, waveforms
from . import views as v
from .registry import query

_CENTRES = f"""WITH {v.LONG}, m AS (SELECT label, "offset", channel, median(value) AS med, avg(value) AS mean, stddev_pop(value) AS std FROM long GROUP BY ALL)"""
_VECS = _CENTRES + """, vec AS (SELECT label, list(med ORDER BY channel, "offset") AS x FROM m GROUP BY 1)"""


def _centres(spark, d):
    return waveforms.centroids(waveforms.long_form(v.waves(spark, d), "vec_id", "wf", v.CHANNELS, "label"), "label")


def _vectors(spark, d):
    long = waveforms.long_form(v.waves(spark, d), "vec_id", "wf", v.CHANNELS, "label")
    return metrics.vectors(long.groupBy("label", "offset", "channel").agg(F.median("value").alias("median")), "label")


@query(
    "T01_centroids",
    _CENTRES + """ SELECT label, "offset", channel, round(any_value(med), 6) AS median, round(any_value(mean), 6) AS mean, round(any_value(std), 6) AS std, round(median(abs(value - med)) * 1.4826, 6) AS mad FROM long JOIN m USING (label, "offset", channel) GROUP BY ALL""",
)
def t01(spark, d):
    return v.round_all(_centres(spark, d), "median", "mean", "std", "mad")


@query(
    "T01_centroid_summary",
    _CENTRES + """ SELECT label, arg_min(channel, med) FILTER ("offset" = 6) AS extremum_channel, round(min(med) FILTER ("offset" = 6), 6) AS extremum_amplitude, round(sqrt(avg(med * med)), 6) AS waveform_rms, round(min(med), 6) AS low, round(max(med), 6) AS high FROM m GROUP BY 1""",
)
def t01s(spark, d):
    return v.round_all(waveforms.centroid_summary(_centres(spark, d), "label", 6), "extremum_amplitude", "waveform_rms", "low", "high")


@query("F06_peak_max", "SELECT vec_id, round(embedding[25]::DOUBLE, 6) AS f0, round(embedding[28]::DOUBLE, 6) AS f3 FROM embeddings")
def f06(spark, d):
    f = waveforms.value_at(v.waves(spark, d), "vec_id", "wf", v.CHANNELS, 6)
    return f.select("vec_id", F.round(F.col("features")[0], 6).alias("f0"), F.round(F.col("features")[3], 6).alias("f3"))


@query("P10_sparse_mask", _CENTRES + " SELECT label, channel, max(abs(med)) > 0.35 AS kept FROM m GROUP BY ALL")
def p10(spark, d):
    return waveforms.sparse_mask(_centres(spark, d), "label", threshold=0.35)


@query("P10_best_channels", _CENTRES + ", t AS (SELECT label, channel, max(abs(med)) AS top FROM m GROUP BY ALL) SELECT label, channel, row_number() OVER (PARTITION BY label ORDER BY top DESC, channel DESC) <= 2 AS kept FROM t")
def p10b(spark, d):
    return waveforms.sparse_mask(_centres(spark, d), "label", nbest=2)


@query(
    "P11_shared_channels",
    _CENTRES
    + """, k AS (SELECT label, channel FROM m GROUP BY ALL HAVING max(abs(med)) > 0.35), n AS (SELECT l.label, count(k.channel) AS n FROM (SELECT DISTINCT label FROM m) l LEFT JOIN k USING (label) GROUP BY 1),
    s AS (SELECT a.label AS i, b.label AS j, count(*) AS shared FROM k a JOIN k b USING (channel) GROUP BY ALL)
    SELECT a.label AS label_i, b.label AS label_j, coalesce(shared, 0) AS shared, CASE WHEN least(a.n, b.n) <= 4 THEN coalesce(shared, 0) >= 1 ELSE coalesce(shared, 0) * 2 > least(a.n, b.n) END AS together FROM n a CROSS JOIN n b LEFT JOIN s ON s.i = a.label AND s.j = b.label""",
)
def p11(spark, d):
    return waveforms.shared_channels(waveforms.sparse_mask(_centres(spark, d), "label", threshold=0.35), "label")


@query("G08_common_channels", _CENTRES + ", t AS (SELECT label, channel, max(abs(med)) > 0.35 AS kept FROM m GROUP BY ALL) SELECT channel, bool_or(kept) AS kept FROM t WHERE label IN (2, 5) GROUP BY 1")
def g08(spark, d):
    visible = spark.createDataFrame([(2,), (5,)], "label int")
    return waveforms.common_channels(waveforms.sparse_mask(_centres(spark, d), "label", threshold=0.35), "label", visible)


@query("P14_projection", "SELECT vec_id, round(0.6 * embedding[1]::DOUBLE + 0.8 * embedding[2]::DOUBLE, 6) AS p FROM embeddings")
def p14(spark, d):
    return v.waves(spark, d).select("vec_id", F.round(arrays.project(F.slice("wf", 1, 2), [0.6, 0.8]), 6).alias("p"))


_COSMAX = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) / list_sum(list_transform(list_zip(a.x, b.x), lambda z: greatest(abs(z[1]), abs(z[2])) ** 2))"


@query("A07_cosine_with_max", _VECS + f" SELECT a.label AS label_i, b.label AS label_j, round(CASE WHEN a.label = b.label THEN 1.0 ELSE {_COSMAX} END, 6) AS similarity FROM vec a, vec b")
def a07(spark, d):
    return v.round_all(metrics.cluster_similarity(_vectors(spark, d), "label"), "similarity")


@query("A10_pairs_over_threshold", _VECS + f" SELECT a.label AS label_i, b.label AS label_j, round({_COSMAX}, 6) AS similarity FROM vec a JOIN vec b ON a.label < b.label WHERE {_COSMAX} > 0.02")
def a10(spark, d):
    return v.round_all(metrics.pairs_over(metrics.cluster_similarity(_vectors(spark, d), "label"), 0.02), "similarity")


@query("A09_ratio_similarity", _VECS.replace("list(med ORDER", "list(med / (SELECT max(abs(q.med)) FROM m q WHERE q.label = m.label) ORDER") + f" SELECT a.label AS label_i, b.label AS label_j, round(CASE WHEN a.label = b.label THEN 1.0 ELSE {_COSMAX} END, 6) AS similarity FROM vec a, vec b")
def a09(spark, d):
    return v.round_all(metrics.ratio_similarity(_vectors(spark, d), "label"), "similarity")


_KERNELS = {
    "cosine": "list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x))",
    "linear": "list_dot_product(a.x, b.x)",
    "polynomial": "(list_dot_product(a.x, b.x) / 64 + 1) ** 3",
    "sigmoid": "tanh(list_dot_product(a.x, b.x) / 64 + 1)",
    "rbf": "exp(-(list_distance(a.x, b.x) ** 2) / 64)",
    "laplacian": "exp(-list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]))) / 64)",
}


def _kernel_query(name: str, sql: str) -> None:
    @query(f"A08_{name}_kernel", _VECS + f" SELECT a.label AS label_i, b.label AS label_j, round({sql}, 6) AS similarity FROM vec a, vec b")
    def run(spark, d):
        return v.round_all(metrics.kernel_similarity(_vectors(spark, d), "label", name, v.WIDTH * v.CHANNELS), "similarity")


for _name, _sql in _KERNELS.items():
    _kernel_query(_name, _sql)


@query(
    "A05_density",
    f"""WITH {v.LONG} SELECT label, channel, "offset", CAST(greatest(0, least(19, floor((value + 2.0) / 0.2))) AS BIGINT) AS bin, count(*) AS n FROM long GROUP BY ALL""",
)
def a05(spark, d):
    return waveforms.density(waveforms.long_form(v.waves(spark, d), "vec_id", "wf", v.CHANNELS, "label"), ["label"], -2.0, 2.0, 20)


@query("A06_feature_histogram", "SELECT least(CAST(floor((embedding[1]::DOUBLE + 4.0) / 0.08) AS BIGINT), 99) AS bin, count(*) AS n FROM embeddings WHERE embedding[1] BETWEEN -4 AND 4 GROUP BY 1")
def a06(spark, d):
    return trains.histogram(v.waves(spark, d).select(F.col("wf")[0].alias("x")), F.col("x"), -4.0, 4.0, 0.08, [])


@query(
    "A11_silhouette",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT a.vec_id, a.label, b.label AS o, sum(list_distance(a.x, b.x)) AS t, count(*) AS n FROM e a, e b GROUP BY ALL),
    m AS (SELECT vec_id, label, max(t / (n - 1)) FILTER (label = o AND n > 1) AS a, min(t / n) FILTER (label <> o) AS b FROM s GROUP BY ALL)
    SELECT vec_id, label, round(coalesce((b - a) / greatest(a, b), 0), 5) AS silhouette FROM m WHERE b IS NOT NULL""",
)
def a11(spark, d):
    return v.round_all(metrics.silhouette(v.waves(spark, d), "vec_id", "label", "wf"), "silhouette", digits=5)


@query("A13_min_max_centroids", _CENTRES + ' SELECT round(min(med), 6) AS low, round(max(med), 6) AS high FROM m')
def a13(spark, d):
    return v.round_all(_centres(spark, d).agg(F.min("median").alias("low"), F.max("median").alias("high")), "low", "high")


@query("J06_cluster_pairs", _VECS + " SELECT a.label AS label_i, b.label AS label_j, round(list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]))), 6) AS similarity FROM vec a JOIN vec b ON a.label < b.label")
def j06(spark, d):
    gap = metrics.pairwise(_vectors(spark, d), "label", lambda a, b: arrays.total(F.zip_with(a, b, lambda x, y: F.abs(x - y))), all_pairs=False)
    return v.round_all(gap, "similarity")


@query("P05_waveform_aliens", "SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: abs(x::DOUBLE) > 2.5)) > 0 THEN -9 ELSE label END AS label FROM embeddings")
def p05w(spark, d):
    return trains.mark_aliens_by_waveform(v.waves(spark, d), "wf", "label", 2.5).select("vec_id", "label")


@query("K16_alignment", _CENTRES + ', t AS (SELECT label, arg_min("offset", med) AS place FROM m GROUP BY 1) SELECT vec_id, CASE WHEN abs(6 - place) > 2 THEN -1 ELSE label END AS label FROM embeddings JOIN t USING (label)')
def k16(spark, d):
    from ..operators.curation import trash_misaligned

    low = _centres(spark, d).groupBy("label").agg(F.min_by("offset", "median").alias("offset"))
    return trash_misaligned(v.waves(spark, d).select("vec_id", "label"), low, -6, 2, "label").select("vec_id", "label")


@query(
    "A12_cluster_report",
    f"""WITH {v.CLUSTERS}, {v.TRAIN}, n AS (SELECT cluster_label, count(*) AS nb FROM train GROUP BY 1) SELECT cluster_label, cell_label, extremum_channel, CASE WHEN extremum_channel < 8 THEN extremum_channel::INT END AS local_channel,
    extremum_amplitude, extremum_amplitude * (extremum_channel + 1) * 0.5 AS amplitude_uv, coalesce(nb, 0) AS nb_spike FROM clusters LEFT JOIN n USING (cluster_label)""",
)
def a12(spark, d):
    mads = spark.range(16).select(F.col("id").alias("channel"), (F.col("id") + 1.0).alias("mad"))
    return metrics.cluster_report(v.clusters(spark, d), v.probe(spark), mads, v.train(spark, d), 0.5)


@query(
    "J07_overlap_triples",
    _CENTRES
    + """, l AS (SELECT DISTINCT label FROM m), g AS (SELECT w.label, f.label AS first, s.label AS second, sh AS shift, max(abs(mw.med - mf.med - coalesce(ms.med, 0))) AS distance
    FROM l w JOIN l f ON f.label <> w.label JOIN l s ON f.label <= s.label AND s.label <> w.label CROSS JOIN range(-2, 3) r(sh) JOIN m mw ON mw.label = w.label JOIN m mf ON mf.label = f.label AND mf."offset" = mw."offset" AND mf.channel = mw.channel
    LEFT JOIN m ms ON ms.label = s.label AND ms.channel = mw.channel AND ms."offset" = mw."offset" - sh GROUP BY ALL)
    SELECT label, arg_min(first, (round(distance, 9), first, second, shift)) AS first, arg_min(second, (round(distance, 9), first, second, shift)) AS second, arg_min(shift, (round(distance, 9), first, second, shift))::INT AS shift, round(min(distance), 6) AS distance FROM g GROUP BY 1""",
)
def j07(spark, d):
    return _overlaps(v.waves(spark, d))


def _overlaps(waves):
    m = waveforms.long_form(waves, "vec_id", "wf", v.CHANNELS, "label").groupBy("label", "offset", "channel").agg(F.median("value").alias("median"))
    return v.round_all(metrics.overlaps(m, "label", 2), "distance")


@query("G04_similar_pairs", _VECS + f" SELECT a.label AS label_i, b.label AS label_j, row_number() OVER (ORDER BY round({_COSMAX}, 9) DESC, a.label, b.label) AS position FROM vec a JOIN vec b ON a.label < b.label")
def g04(spark, d):
    from pyspark.sql import Window

    s = metrics.cluster_similarity(_vectors(spark, d), "label").filter("label_i < label_j")
    order = Window.orderBy(F.desc(F.round("similarity", 9)), "label_i", "label_j")
    return s.select("label_i", "label_j", F.row_number().over(order).cast("long").alias("position"))


@query(
    "G09_components_near_channels",
    _CENTRES + """, e AS (SELECT label, arg_max(channel, abs(med)) AS c FROM m GROUP BY 1) SELECT label, i AS component FROM e, range(64) r(i) WHERE abs(i // 16 - c) <= 1""",
)
def g09(spark, d):
    e = _centres(spark, d).groupBy("label").agg(F.max_by("channel", F.abs(F.col("median"))).alias("_c"))
    parts = spark.range(64).select(F.col("id").alias("component"), F.floor(F.col("id") / 16).alias("_p"))
    near = e.select("label", F.explode(F.sequence(F.col("_c").cast("long") - 1, F.col("_c").cast("long") + 1)).alias("_p"))
    return parts.join(F.broadcast(near), "_p").select("label", "component")


@query("G10_similarity_in_label_order", _VECS + f" SELECT a.label AS label_i, list(round(CASE WHEN a.label = b.label THEN 1.0 ELSE {_COSMAX} END, 6) ORDER BY b.label) AS row_values FROM vec a, vec b GROUP BY 1")
def g10(spark, d):
    s = metrics.cluster_similarity(_vectors(spark, d), "label")
    cells = F.array_sort(F.collect_list(F.struct("label_j", F.round("similarity", 6).alias("s"))))
    return s.groupBy("label_i").agg(F.transform(cells, lambda c: c["s"]).alias("row_values"))


@query(
    "G15_centroid_view",
    _CENTRES
    + """, k AS (SELECT channel FROM m WHERE label IN (2, 5) GROUP BY channel HAVING max(abs(med)) > 0.35), x AS (SELECT label, "offset", channel, any_value(med) AS med, median(abs(value - med)) * 1.4826 AS mad FROM long JOIN m USING (label, "offset", channel) GROUP BY ALL)
    SELECT label, channel, "offset", round(med - mad, 6) AS low, round(med + mad, 6) AS high FROM x JOIN k USING (channel) WHERE label IN (2, 5)""",
)
def g15(spark, d):
    c = _centres(spark, d).filter("label in (2, 5)")
    kept = waveforms.sparse_mask(c, "label", threshold=0.35).filter("kept").select("channel").distinct()
    return v.round_all(c.join(F.broadcast(kept), "channel").select("label", "channel", "offset", (F.col("median") - F.col("mad")).alias("low"), (F.col("median") + F.col("mad")).alias("high")), "low", "high")


@query("A12_noise_report", "SELECT 0.5::DOUBLE AS min_uv, 8::DOUBLE AS max_uv, 4.25::DOUBLE AS mean_uv, 21.25::DOUBLE AS threshold_uv")
def a12n(spark, d):
    mads = spark.range(16).select(F.col("id").alias("channel"), (F.col("id") + 1.0).cast("double").alias("mad"))
    return metrics.noise_report(mads, 5.0, 0.5)
