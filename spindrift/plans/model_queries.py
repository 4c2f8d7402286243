"""Queries over filters, features, clustering, catalogues and matching. SQL oracles stand where SQL can express them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalogue, clustering, features, filters, metrics, peeling, reachability, shears, waveforms
from ..sources.raw import to_frames, to_long
from . import views as v
from .registry import query


def _frames(spark, d) -> DataFrame:
    return to_frames(v.signal(spark, d))


def _rounded_frames(df: DataFrame) -> DataFrame:
    return to_long(df).select("segment", "sample", "channel", F.round("value", 3).alias("value"))


@query("W01_zero_phase_segments")
def w01(spark, d):
    p = filters.Preprocessing(10000.0, 500.0, 4000.0, common_reference=True)
    return _rounded_frames(filters.preprocess_blocks(_frames(spark, d), p, 1 << 20, 0))


@query("W02_halo_filter")
def w02(spark, d):
    p = filters.Preprocessing(10000.0, 500.0, 4000.0, smooth=1)
    return _rounded_frames(filters.preprocess_blocks(_frames(spark, d), p, 128, 100))


@query("W08_array_noise", f"WITH {v.SIGNAL}, s AS (SELECT channel, value::FLOAT::DOUBLE AS value FROM signal WHERE sample < 256), m AS (SELECT channel, median(value) AS med FROM s GROUP BY 1) SELECT channel, round(any_value(med), 3) AS median, round(median(abs(value - med)) * 1.4826, 3) AS mad FROM s JOIN m USING (channel) GROUP BY 1")
def w08(spark, d):
    s = to_long(_frames(spark, d).filter("sample < 256"))
    from ..functions.robust import median_mad

    return v.round_all(median_mad(s, ["channel"], "value"), "median", "mad", digits=3)


@query("F05_global_svd")
def f05(spark, d):
    f, _ = features.global_svd(v.waves(spark, d), "vec_id", "wf", 5)
    return f.select("vec_id", F.transform("features", lambda x: F.round(x, 5)).alias("features"))


@query("F07_svd_by_channel")
def f07(spark, d):
    w = v.waves(spark, d).withColumn("peak_channel", (F.col("vec_id") % v.CHANNELS).cast("int"))
    return v.round_all(features.svd_by_channel(w, "vec_id", "wf", v.CHANNELS, "peak_channel"), "value", digits=5)


@query("F08_discriminants")
def f08(spark, d):
    w = v.waves(spark, d)
    return features.transform(w, "vec_id", "wf", features.discriminants(w, "wf", "label", 3)).select("vec_id", F.transform("features", lambda x: F.round(x, 4)).alias("features"))


WHOLE = ("agglomerative", "dbscan", "hdbscan", "meanshift")


def _clustered(method: str, **options):
    def run(spark, d):
        f, _ = features.global_svd(v.waves(spark, d), "vec_id", "wf", 5)
        if method == "optics":
            return reachability.optics_table(f, "vec_id", **options)
        return clustering.find_clusters(f, "vec_id", method, whole=method in WHOLE, **options)

    return run


for _name, _method, _options in (
    ("K02_kmeans", "kmeans", {"n_clusters": 5}),
    ("K03_onecluster", "onecluster", {}),
    ("K04_gmm", "gmm", {"n_clusters": 3}),
    ("K05_agglomerative", "agglomerative", {"n_clusters": 5}),
    ("K06_dbscan", "dbscan", {"eps": 1.0}),
    ("K07_hdbscan", "hdbscan", {"min_cluster_size": 10}),
    ("K09_optics", "optics", {}),
    ("K10_meanshift", "meanshift", {}),
):
    query(_name, "SELECT vec_id, 0::BIGINT AS cluster_label FROM embeddings" if _method == "onecluster" else None)(_clustered(_method, **_options))


@query("K08_hdbscan_with_noise")
def k08(spark, d):
    """Noise rows are what is left of each waveform without the mean of its label."""
    f, _ = features.global_svd(v.waves(spark, d), "vec_id", "wf", 3)
    own = v.waves(spark, d).select("vec_id", "label").join(f, "vec_id")
    means = own.groupBy("label").agg(F.array(*[F.avg(F.col("features")[i]) for i in range(3)]).alias("mean"))
    noise = own.join(means, "label").select(F.zip_with("features", "mean", lambda x, m: x - m).alias("features"))
    return clustering.find_clusters(f, "vec_id", "dbscan_with_noise", noise=noise, whole=True, min_cluster_size=10)


#: Points of the first three numbers of each vector.
_PLACES = "p AS (SELECT vec_id AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def _places(spark, d):
    return v.waves(spark, d).select("vec_id", F.slice("wf", 1, 3).alias("features"))


@query(
    "K06_dbscan_places",
    f"""WITH RECURSIVE {_PLACES}, n AS (SELECT a.i, b.i AS j FROM p a, p b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.06),
    c AS (SELECT i FROM n GROUP BY i HAVING count(*) >= 6), e AS (SELECT n.i, n.j FROM n JOIN c ON c.i = n.i JOIN c o ON o.i = n.j),
    r(i, j) AS (SELECT i, i FROM c UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j), k AS (SELECT i, min(j) AS g FROM r GROUP BY i),
    l AS (SELECT * FROM k UNION ALL SELECT n.i, min(k.g) FROM n JOIN k ON k.i = n.j WHERE n.i NOT IN (SELECT i FROM c) GROUP BY n.i),
    m AS (SELECT i, dense_rank() OVER (ORDER BY g) - 1 AS label FROM l) SELECT p.i AS vec_id, coalesce(m.label, -1) AS cluster_label FROM p LEFT JOIN m USING (i)""",
)
def k06_places(spark, d):
    return clustering.find_clusters(_places(spark, d), "vec_id", "dbscan", whole=True, eps=0.06, min_samples=6)


@query(
    "K07_spanning_tree",
    f"""WITH {_PLACES}, n AS (SELECT a.i, b.i AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM p a JOIN p b ON a.i <> b.i),
    o AS (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM n), c AS (SELECT i, d AS core FROM o WHERE r = 4)
    SELECT (SELECT count(*) - 1 FROM p) AS edges, (SELECT round(sum(core), 6) FROM c) AS cores, 1::BIGINT AS parts,
        (SELECT count(*) FROM (SELECT n.i FROM n JOIN c ON c.i = n.i JOIN c e ON e.i = n.j GROUP BY n.i)) AS spanned,
        (SELECT round(sum(w), 6) FROM (SELECT DISTINCT ON (i) i, greatest(d, c.core, e.core) AS w FROM n JOIN c USING (i) JOIN c e ON e.i = n.j ORDER BY i, w)) AS least""",
)
def k07_tree(spark, d):
    """Of the spanning tree: edges, components that they make, points spanned; the sums of core distances and of each point's least edge, which lies in any such tree."""
    from ..operators import density, graph, linkage, neighbours

    points = graph.saved(density.points_of(_places(spark, d), "vec_id", "features"), "points")
    heads = neighbours.Pivots(points)
    cores, near = neighbours.k_nearest(points, 4, heads)
    tree = linkage.spanning_tree(cores, near, heads)
    ends = tree.select("_w", F.explode(F.array("_lo", "_hi")).alias("_id"))
    of = graph.components(tree, "_lo", "_hi").agg(F.countDistinct("component").alias("parts"))
    own = ends.groupBy("_id").agg(F.min("_w").alias("_w")).agg(F.count(F.lit(1)).alias("spanned"), F.round(F.sum("_w"), 6).alias("least"))
    return tree.agg(F.count(F.lit(1)).alias("edges")).join(of).join(own).join(cores.agg(F.round(F.sum("_core"), 6).alias("cores")))


def _pulled(spark, d):
    """Places of labels, far apart: the first two numbers of each vector around a point of its label."""
    w = v.waves(spark, d).select("vec_id", "label", F.slice("wf", 1, 2).alias("_p"))
    return w.select("vec_id", "label", F.array(F.col("_p")[0] + 10 * (F.col("label") % 3), F.col("_p")[1] + 10 * F.floor(F.col("label") / 3)).alias("features"))


def _per_label(found, pulled, name: str):
    """Of each label its clusters, and the rows of the largest cluster that any of its members is in."""
    sizes = found.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("_n"))
    both = found.join(sizes, "cluster_label").join(pulled.select("vec_id", "label"), "vec_id").groupBy(F.col("label").cast("long").alias("label"))
    return both.agg(F.countDistinct("cluster_label").alias(name), F.max("_n").alias("members"))


@query(
    "K10_modes_found",
    "SELECT label::BIGINT AS label, 1::BIGINT AS modes, count(*) AS members FROM embeddings GROUP BY 1",
)
def k10_modes(spark, d):
    """Waveforms pulled to places of their labels, far apart: one mode for each label, with all its members."""
    pulled = _pulled(spark, d)
    return _per_label(clustering.find_clusters(pulled, "vec_id", "meanshift", whole=True, bandwidth=2.0), pulled, "modes")


@query("K11_isosplit_places", "SELECT label::BIGINT AS label, 1::BIGINT AS clusters, count(*) AS members FROM embeddings GROUP BY 1")
def k11_places(spark, d):
    """The same places, split until no line between two parcels shows two modes or one that both share: a cluster for each label."""
    pulled = _pulled(spark, d)
    return _per_label(clustering.find_clusters(pulled, "vec_id", "isosplit5", whole=True), pulled, "clusters")


@query("K05_ward_places", "SELECT label::BIGINT AS label, 1::BIGINT AS clusters, count(*) AS members FROM embeddings GROUP BY 1")
def k05_places(spark, d):
    """Ward's hierarchy of the same places, cut at the number of labels: a cluster for each label, with all its members."""
    pulled = _pulled(spark, d)
    k = pulled.select("label").distinct().count()
    return _per_label(clustering.find_clusters(pulled, "vec_id", "agglomerative", whole=True, n_clusters=k), pulled, "clusters")


@query("K12_saw_chain_cut")
def k12(spark, d):
    from ..operators import sawchain

    w = v.waves(spark, d).select("vec_id", "wf")
    top = F.array(*[F.array_max(F.transform(F.sequence(F.lit(0), F.lit(v.WIDTH - 1)), lambda i, c=c: F.abs(F.get("wf", i * v.CHANNELS + c)))) * 10 for c in range(v.CHANNELS)])
    found = sawchain.saw_chain_table(w.select("vec_id", top.alias("amplitudes")), "vec_id", "amplitudes", 2.0)
    return sawchain.merge_close(found, w, "vec_id", "wf", v.CHANNELS, 0.2)


@query(
    "K12_saw_chain_labels",
    """WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label::BIGINT AS label, CASE WHEN label = 0 OR n < 20 THEN 0 ELSE 1 END::BIGINT AS classes, n AS members FROM s""",
)
def k12_labels(spark, d):
    """Amplitudes raised on one of three channels, by the label: each label but the first, which stays under the threshold, is a class."""
    from ..operators import sawchain

    w = v.waves(spark, d).select("vec_id", "label", F.slice("wf", 1, 3).alias("_p"))
    amps = F.array(*[F.col("_p")[c] + F.when((F.col("label") > 0) & ((F.col("label") - 1) % 3 == c), 15 + 12 * F.floor((F.col("label") - 1) / 3)).otherwise(0) for c in range(3)])
    found = sawchain.saw_chain_table(w.select("vec_id", amps.alias("amplitudes")), "vec_id", "amplitudes", 5.0)
    sized = found.join(found.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("_n")), "cluster_label")
    both = sized.join(w.select("vec_id", "label"), "vec_id").groupBy(F.col("label").cast("long").alias("label"))
    return both.agg(F.count_distinct(F.when(F.col("cluster_label") >= 0, F.col("cluster_label"))).alias("classes"), F.max("_n").alias("members"))


@query("K13_pruning_shears")
def k13(spark, d):
    w = v.waves(spark, d).select("vec_id", "wf")
    # sample-major to channel-major
    flat = F.array(*[F.col("wf")[i * v.CHANNELS + c] for c in range(v.CHANNELS) for i in range(v.WIDTH)])
    tops = F.array(*[F.array_max(F.transform(F.slice("_x", c * v.WIDTH + 1, v.WIDTH), F.abs)) for c in range(v.CHANNELS)])
    peaks = w.select("vec_id", flat.alias("_x")).withColumn("_tops", tops)
    peaks = peaks.select("vec_id", "_x", (F.array_position("_tops", F.array_max("_tops")) - 1).alias("peak_channel"), F.array_max("_tops").alias("amplitude"))
    near = np.abs(np.subtract.outer(np.arange(v.CHANNELS), np.arange(v.CHANNELS))) <= 1
    return shears.pruning_shears_table(peaks, "vec_id", "_x", np.repeat(np.arange(v.CHANNELS), v.WIDTH), "peak_channel", "amplitude", near, 10)


@query("K14_dip_test")
def k14(spark, d):
    return v.round_all(clustering.dip_by_group(v.train(spark, d).select("cluster_label", "extremum_amplitude"), ["cluster_label"], "extremum_amplitude"), "dip", "p", digits=6)


@query("K15_auto_split")
def k15(spark, d):
    f, _ = features.global_svd(v.waves(spark, d), "vec_id", "wf", 3)
    return clustering.auto_split(f.join(v.waves(spark, d).select("vec_id", "label"), "vec_id"), "vec_id", "label", min_cluster_size=10)


@query(
    "K17_close_templates",
    f"""WITH {v.LONG}, m AS (SELECT label, "offset", channel, median(value) AS med FROM long GROUP BY ALL), t AS (SELECT label, max(abs(med)) AS top FROM m GROUP BY 1),
    g AS (SELECT a.label AS i, b.label AS j, s, max(abs(a.med - b.med)) AS gap FROM m a JOIN m b ON a.label < b.label AND a.channel = b.channel, range(-2, 3) r(s) WHERE a."offset" BETWEEN 2 AND 13 AND b."offset" = a."offset" + s GROUP BY ALL)
    SELECT i AS label_i, j AS label_j, min(gap) < greatest(0.3 * greatest(any_value(x.top), any_value(y.top)), 0.2) AS close FROM g JOIN t x ON x.label = i JOIN t y ON y.label = j GROUP BY i, j""",
)
def k17(spark, d):
    long = waveforms.long_form(v.waves(spark, d), "vec_id", "wf", v.CHANNELS, "label")
    m = long.groupBy("label", "offset", "channel").agg(F.median("value").alias("med"))
    a = m.filter(F.col("offset").between(2, v.WIDTH - 3)).select(F.col("label").alias("label_i"), F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("s"), "offset", "channel", F.col("med").alias("_a"))
    b = m.select(F.col("label").alias("label_j"), F.col("offset").alias("_o"), "channel", F.col("med").alias("_b"))
    gaps = a.withColumn("_o", F.col("offset") + F.col("s")).join(b, ["_o", "channel"]).filter("label_i < label_j").groupBy("label_i", "label_j", "s").agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("gap"))
    best = gaps.groupBy("label_i", "label_j").agg(F.min("gap").alias("gap"))
    top = m.groupBy("label").agg(F.max(F.abs("med")).alias("top"))
    out = best.join(top.select(F.col("label").alias("label_i"), F.col("top").alias("_ti")), "label_i").join(top.select(F.col("label").alias("label_j"), F.col("top").alias("_tj")), "label_j")
    return out.select("label_i", "label_j", (F.col("gap") < F.greatest(0.3 * F.greatest("_ti", "_tj"), F.lit(0.2))).alias("close"))


def _catalogue(width: int = 16, channels: int = 8) -> catalogue.Catalogue:
    """Three templates on a line of channels: pulses of different places and sizes."""
    t = np.arange(2 * width) - width
    pulse = -np.exp(-0.5 * (t / 2.0) ** 2)
    centers = np.zeros((3, 2 * width, channels))
    for k, (ch, size) in enumerate(((1, 300.0), (4, 250.0), (6, 400.0))):
        for c in range(channels):
            centers[k, :, c] = size * pulse * np.exp(-abs(c - ch))
    near = [[c for c in range(channels) if abs(c - a) <= 1] for a in range(channels)]
    return catalogue.make_catalogue([0, 1, 2], centers, -width // 2, width // 2, -width, 10000.0, 120.0, 3, neighbours=near)


@query("T05_catalogue_row")
def t05(spark, d):
    return catalogue.to_row(spark, _catalogue()).select("chan_grp", "name", F.map_keys("arrays").alias("arrays"))


@query("T06_empty_catalogue")
def t06(spark, d):
    return catalogue.to_row(spark, catalogue.empty_catalogue(8), "empty").select("chan_grp", "name", "meta")


@query("X01_peel_segments")
def x01(spark, d):
    return peeling.peel_segments(_frames(spark, d), _catalogue(), keep_bad=True).select("segment", "index", "cluster_label")


@query("X01_peel_in_chunks")
def x01c(spark, d):
    return peeling.peel_segments(_frames(spark, d), _catalogue(), chunk=200).select("segment", "index", "cluster_label")


@query("X06_template_scores", f"WITH {v.LONG} SELECT vec_id, l.k AS label, round(sum(value * CASE WHEN channel = l.k THEN 0.1 * (\"offset\" - 7) ELSE 0 END), 5) AS score FROM long, (SELECT unnest([0, 1, 2]::BIGINT[]) AS k) l GROUP BY ALL")
def x06(spark, d):
    p = np.zeros((3, v.WIDTH, v.CHANNELS))
    for k in range(3):
        p[k, :, k] = 0.1 * (np.arange(v.WIDTH) - 7)
    c = catalogue.make_catalogue([0, 1, 2], np.zeros((3, v.WIDTH, v.CHANNELS)), -8, 8, -8, 1.0, 1.0, 1)
    c.projections, c.masks[0] = p, np.ones((3, v.CHANNELS), bool)
    return v.round_all(peeling.score_peaks(v.waves(spark, d), c, "vec_id", "wf"), "score", digits=5)


_TEMPLATES = "t AS (SELECT (i // 32)::BIGINT AS cluster_label, (i // 8 % 4 - 1)::INT AS \"offset\", (i % 8)::INT AS channel, (i % 7 - 3)::DOUBLE AS value FROM range(96) r(i))"


def _templates(spark):
    i = F.col("id")
    return spark.range(96).select(F.floor(i / 32).alias("cluster_label"), (F.floor(i / 8) % 4 - 1).cast("int").alias("offset"), (i % 8).cast("int").alias("channel"), (i % 7 - 3).cast("double").alias("value"))


def _spikes(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.floor(F.col("event_id") / 4096).cast("int").alias("segment"), F.floor((F.col("event_id") % 4096) / 8).alias("index"), (F.col("user_id") % 5 - 1).alias("cluster_label"))


_SPIKES = 's AS (SELECT CAST(event_id // 4096 AS INT) AS segment, (event_id % 4096) // 8 AS "index", user_id % 5 - 1 AS cluster_label FROM events)'


@query("X13_prediction", f'WITH {_SPIKES}, {_TEMPLATES} SELECT segment, "index" + "offset" AS sample, channel, sum(value) AS value FROM s JOIN t USING (cluster_label) WHERE cluster_label >= 0 GROUP BY ALL')
def x13(spark, d):
    return waveforms.reconstruct(_spikes(spark, d), _templates(spark))


@query(
    "X13_residual",
    f'WITH {v.SIGNAL}, {_SPIKES}, {_TEMPLATES}, p AS (SELECT segment, "index" + "offset" AS sample, channel, sum(value) AS p FROM s JOIN t USING (cluster_label) WHERE cluster_label >= 0 GROUP BY ALL) SELECT segment, sample, channel, round(value - coalesce(p, 0), 6) AS value FROM signal LEFT JOIN p USING (segment, sample, channel)',
)
def x13r(spark, d):
    return v.round_all(waveforms.residual(v.signal(spark, d), waveforms.reconstruct(_spikes(spark, d), _templates(spark))), "value")


@query(
    "J01_waveform_cut",
    f"""WITH {v.SIGNAL}, p AS (SELECT event_id AS peak_id, CAST(event_id // 4096 AS INT) AS segment, (event_id % 4096) // 8 AS "index" FROM events), l AS (SELECT segment, max(sample) + 1 AS length FROM signal GROUP BY 1)
    SELECT peak_id, CAST(sample - "index" + 5 AS INT) AS "offset", channel, round(value, 6) AS value FROM p JOIN l USING (segment) JOIN signal USING (segment) WHERE sample >= "index" - 5 AND sample < "index" + 7 AND "index" - 5 >= 0 AND "index" - 5 < length - 12""",
)
def j01(spark, d):
    return _cut(spark, d)


def _cut(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    peaks = e.select(F.col("event_id").alias("peak_id"), F.floor(F.col("event_id") / 4096).cast("int").alias("segment"), F.floor((F.col("event_id") % 4096) / 8).alias("index"))
    s = v.signal(spark, d)
    lengths = s.groupBy("segment").agg((F.max("sample") + 1).alias("length"))
    return v.round_all(waveforms.cut_windows(peaks, s, -5, 7, lengths, block=64), "value")


@query("F02_noise_snippets")
def f02(spark, d):
    s = v.signal(spark, d)
    lengths = s.groupBy("segment").agg((F.max("sample") + 1).alias("length")).filter("length > 100")
    return waveforms.noise_positions(lengths, _spikes(spark, d), -8, 12, 30)


@query("X12_jitter", "SELECT vec_id, round((embedding[1]::DOUBLE - embedding[3]::DOUBLE) / (2 * (embedding[1]::DOUBLE - 2 * embedding[2]::DOUBLE + embedding[3]::DOUBLE)), 3) AS jitter FROM embeddings WHERE abs(embedding[1] - 2 * embedding[2] + embedding[3]) > 0.05")
def x12(spark, d):
    w = v.waves(spark, d).filter(F.abs(F.col("wf")[0].cast("float") - 2 * F.col("wf")[1].cast("float") + F.col("wf")[2].cast("float")) > 0.05)
    return w.select("vec_id", F.round(waveforms.jitter(F.col("wf")[0], F.col("wf")[1], F.col("wf")[2]), 3).alias("jitter"))


@query("G05_silhouette_by_label")
def g05(spark, d):
    s = metrics.silhouette(v.waves(spark, d), "vec_id", "label", "wf")
    return metrics.silhouette_by_label(s, "label").select("label", F.round("mean", 5).alias("mean"), F.size("silhouettes").alias("n"))


@query("T07_planted_events", "SELECT k AS template, true AS found, true AS pure FROM range(3) t(k)")
def t07(spark, d):
    """The whole pipeline on a synthetic recording: each planted template's events are found, nearly all under labels that are this template's."""
    from ..operators import detect
    from ..sources.raw import from_arrays
    from ..sources.synthetic import recording
    from . import pipeline

    x, truth = recording(24_000, seed=8, gap=110)
    p = pipeline.automatic(4, 15000.0, highpass=300.0, threshold=8.0, left_ms=-1.0, right_ms=1.3, min_cluster_size=15, block=6000)
    _, spikes = pipeline.sort_recording(from_arrays(spark, [x]), detect.default_geometry(spark, 0, [0, 1, 2, 3]), p)
    planted = spark.createDataFrame([(int(at), int(k)) for at, k in truth], "at long, template long")
    found = spikes.filter("cluster_label >= 0").select("index", "cluster_label")
    met = planted.join(found, F.abs(F.col("index") - F.col("at")) <= 3, "left").groupBy("template", "cluster_label").agg(F.count(F.lit(1)).alias("n"))
    owner = met.filter("cluster_label is not null").groupBy("cluster_label").agg(F.max_by("template", "n").alias("owner"))
    met = met.join(owner, "cluster_label", "left")
    hit = F.sum(F.when(F.col("cluster_label").isNotNull(), F.col("n")).otherwise(0))
    own = F.sum(F.when(F.col("owner") == F.col("template"), F.col("n")).otherwise(0))
    return met.groupBy("template").agg((hit > 0.85 * F.sum("n")).alias("found"), (own > 0.9 * hit).alias("pure"))
