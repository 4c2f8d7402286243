import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import catalogue, clustering, curation, detect, features, peeling, trains, waveforms
from spindrift.plans import pipeline
from spindrift.sources.raw import from_arrays, to_long

from .fixtures import recording, templates

NEAR = [[c for c in range(4) if abs(c - a) <= 1] for a in range(4)]


def made(width=60):
    return catalogue.make_catalogue([0, 1, 2], templates(width=width), -15, 20, -30, 15000.0, 6.0, 5, neighbours=NEAR)


def blobs(sizes=(60, 80, 50), noise=0, seed=0):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(0, 0.4, (n, 2)) + c for n, c in zip(sizes, ((0, 0), (6, 0), (0, 7)), strict=False)] + [r.uniform(-8, 12, (noise, 2))])
    return x, np.repeat(np.arange(len(sizes)), sizes)


def agree(a, b):
    """Whether two labelings are the same up to names."""
    return len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(set(a.tolist())) == len(set(b.tolist()))


@pytest.mark.parametrize("method,options", [("dbscan", {"eps": 1.0}), ("hdbscan", {"min_cluster_size": 15}), ("agglomerative", {"n_clusters": 3}), ("optics", {}), ("meanshift", {"bandwidth": 2.0})])
def test_kernels_find_blobs(method, options):
    x, truth = blobs()
    found = clustering.KERNELS[method](x, **options)
    sure = found >= 0
    assert sure.mean() > 0.85 and agree(found[sure], truth[sure])


def test_hdbscan_leaves_scattered_points_out():
    x, truth = blobs(noise=25)
    found = clustering.hdbscan(x, 15)
    assert found.max() == 2 and (found[: len(truth)] >= 0).mean() > 0.8 and (found[len(truth) :] == -1).mean() > 0.5
    assert (clustering.hdbscan(x[:5], 15) == -1).all()


@pytest.mark.parametrize("method,options", [("kmeans", {"n_clusters": 3}), ("gmm", {"n_clusters": 3}), ("onecluster", {}), ("hdbscan", {"min_cluster_size": 15})])
def test_clusters_on_frames(spark, method, options):
    x, truth = blobs()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "peak_id long, features array<double>")
    got = {r.peak_id: r.cluster_label for r in clustering.find_clusters(df, "peak_id", method, first=10, **options).collect()}
    assert len(got) == len(x) and (min(v for v in got.values() if v >= 0) == 10)
    if method == "gmm":  # expectation-maximisation may end in a local optimum
        assert 2 <= len(set(got.values())) <= 3
    elif method != "onecluster":
        labels = np.array([got[i] for i in range(len(x))])
        assert agree(labels[labels >= 0], truth[labels >= 0])


def test_dip_tells_one_mode_from_two():
    r = np.random.default_rng(4)
    two = np.r_[r.normal(-3, 1, 600), r.normal(3, 1, 600)]
    one = r.normal(-3, 1, 1200)
    d2, p2 = clustering.dip_test(two, 100)
    d1, p1 = clustering.dip_test(one, 100)
    assert p2 < 0.05 < p1 and d2 > 3 * d1
    assert clustering.dip_test(np.ones(50)) == (0.0, 1.0)
    assert clustering.dip_test(two, 100) == clustering.dip_test(two, 100)


def test_auto_split_and_templates(spark):
    r = np.random.default_rng(0)
    rows = [(i, 0, [float(v), float(r.normal(0, 0.3)), 0.0]) for i, v in enumerate(np.r_[r.normal(-4, 0.5, 80), r.normal(4, 0.5, 80)])]
    rows += [(1000 + i, 1, [float(v), float(r.normal(0, 1)), 0.0]) for i, v in enumerate(r.normal(0, 1, 120))]
    df = spark.createDataFrame(rows, "peak_id long, cluster_label int, features array<double>")
    parts = clustering.auto_split(df, "peak_id", p_value=0.02).groupBy("cluster_label").agg(F.countDistinct(F.when(F.col("part") >= 0, F.col("part"))).alias("n")).collect()
    assert {x.cluster_label: x.n for x in parts} == {0: 2, 1: 1}
    a = templates()[0]
    assert clustering.close_templates(a, np.roll(a, 1, axis=0)) and not clustering.close_templates(a, templates()[2])
    x = r.normal(0, 1, (200, 5))
    assert clustering.overlapping(x[:100], x[100:]) and not clustering.overlapping(x, x + 9)


def test_saw_chain_and_shears():
    r = np.random.default_rng(2)
    amps = np.abs(r.normal(0, 1, (300, 3)))
    amps[:100, 0] += 20
    amps[100:200, 1] += 12
    found = clustering.saw_chain_cut(amps, 5.0)
    assert found[:100].max() == found[:100].min() >= 0 and found[100:200].max() == found[100:200].min() >= 0 and found[0] != found[100] and (found[200:] == -1).all()
    f = r.normal(0, 0.3, (200, 4))
    f[:100, 0] += 10
    f[100:, 2] += 7
    peak = np.repeat([0, 1], 100)
    labels = clustering.pruning_shears(f, np.array([0, 0, 1, 1]), peak, np.abs(f).max(1), np.eye(2, dtype=bool), 20)
    assert agree(labels[labels >= 0], peak[labels >= 0]) and (labels >= 0).mean() > 0.8


def test_svd_equals_numpy(spark):
    x = np.random.default_rng(3).normal(size=(200, 12)) + 2
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "peak_id long, wf array<double>, label int")
    got, v = features.global_svd(df, "peak_id", "wf", 3)
    _, s, want = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs((v * want[:3]).sum(1)), 1)
    f = np.array([r.features for r in got.orderBy("peak_id").collect()])
    assert np.allclose(np.sqrt((f**2).sum(0)), s[:3])
    by = features.svd_by_channel(df.withColumn("pc", F.col("label")), "peak_id", "wf", 3, "pc")
    assert by.count() == 200 * 9
    d = features.discriminants(df, "wf", "label")
    assert d.shape == (2, 12)


def test_projections_part_templates():
    c = made()
    for i in range(3):
        for j in range(3):
            score = ((c.centers[j] - c.centers[i]) * c.projections[i])[:, c.masks[0][i]].sum()
            assert abs(score) < 1e-9 if i == j else abs(score) >= 1 - 1e-6
    low, high = catalogue.tuned_boundaries(np.random.default_rng(0).normal(0, 0.05, 300), np.random.default_rng(1).normal(1, 0.1, 300))
    assert -0.5 <= low < -0.1 and 0.1 < high <= 0.5


def test_catalogue_round_trip(spark, tmp_path):
    c = made()
    catalogue.save_catalogue(spark, c, str(tmp_path))
    back = catalogue.load_catalogue(spark, str(tmp_path))
    assert back.labels == c.labels and np.array_equal(back.centers_long, c.centers_long) and np.array_equal(back.masks[1], c.masks[1]) and back.neighbours == c.neighbours
    empty = catalogue.from_row(catalogue.to_row(spark, catalogue.empty_catalogue(4)).first())
    assert empty.labels == [] and empty.channels == 4


def test_peeling_finds_events_and_residual_is_noise(spark):
    x, truth = recording(8000)
    residual, found, _ = peeling.Peeler(made()).peel(x)
    assert sorted(found) == truth
    assert residual.std() < 1.1
    got = peeling.peel_segments(from_arrays(spark, [x, x[:3000]]), made()).collect()
    assert sorted((r["index"], r.cluster_label) for r in got if r.segment == 0) == truth
    signal = to_long(from_arrays(spark, [x]))
    spikes = spark.createDataFrame([(0, i, k) for i, k in truth], "segment int, index long, cluster_label long")
    rest = waveforms.residual(signal, waveforms.reconstruct(spikes, peeling.templates_long(spark, made())))
    assert abs(rest.agg(F.stddev("value")).first()[0] - residual.std()) < 0.01


def test_overlapping_events_are_parted():
    shapes, x = templates(), np.zeros((600, 4))
    for at, k in ((200, 2), (212, 0), (400, 1)):
        x[at - 30 : at + 30] += shapes[k]
    _, found, _ = peeling.Peeler(made()).peel(x)
    assert sorted(found) == [(200, 2), (212, 0), (400, 1)]


@pytest.mark.parametrize("chunk", [174, 512, 1023, 1024, 10000])
def test_peeling_does_not_depend_on_chunks(spark, chunk):
    x, truth = recording(6000, seed=5, gap=45)
    whole = sorted(tuple(r)[:3] for r in peeling.peel_segments(from_arrays(spark, [x]), made()).collect())
    parts = peeling.peel_segments(from_arrays(spark, [x]), made(), chunk=chunk).collect()
    assert sorted(tuple(r)[:3] for r in parts) == whole
    blocks = peeling.peel_blocks(from_arrays(spark, [x]), made(), 2000).collect()
    assert sorted(tuple(r)[:3] for r in blocks) == whole


def test_empty_catalogue_detects_only():
    x, truth = recording(4000)
    c = catalogue.empty_catalogue(4, -15, 20, threshold=10.0, n_span=5, neighbours=[[0, 1, 2, 3]] * 4)
    _, found, left = peeling.Peeler(c).peel(x)
    assert found == [] and {k for _, k in left} == {peeling.UNCLASSIFIED} and len(left) >= len(truth)


def test_detector_is_symmetric_in_sign(spark):
    x, _ = recording(3000)
    near = spark.createDataFrame([(a, b) for a in range(4) for b in NEAR[a]], "c1 int, c2 int")
    rows = lambda s, sign, block=None: sorted(tuple(r)[:3] for r in detect.detect_geometrical(s, near, 5.0, 5, sign, block).collect())
    down = to_long(from_arrays(spark, [x]))
    up = down.withColumn("value", -F.col("value"))
    want = rows(down, "-")
    assert want and rows(up, "+") == want and rows(down, "-", 257) == want
    mask = peeling.Peeler(catalogue.empty_catalogue(4, threshold=5.0, n_span=5, neighbours=NEAR)).detect(x.astype(np.float32).astype(float))
    assert [(0, int(i), int(c)) for i, c in np.argwhere(mask)] == want


def test_correlogram_symmetry(spark):
    r = np.random.default_rng(1)
    rows = [(i, int(s), int(t), int(k)) for i, (s, t, k) in enumerate(zip(r.integers(0, 2, 800), r.integers(0, 20000, 800), r.integers(0, 4, 800), strict=True))]
    df = spark.createDataFrame(rows, "peak_id long, segment int, index long, label int")
    got = {(x.label_i, x.label_j, x.bin): x["count"] for x in trains.cross_correlograms(df, "index", "label", "segment", "peak_id", 10000.0, 0.02, 0.001, symmetrize=True).collect()}
    assert len(got) == 16 * 21 and all(got[i, j, b] == got[j, i, -b] for i, j, b in got) and all(got[i, i, 0] == 0 for i in range(4))


def test_curation_chain(spark):
    peaks = spark.createDataFrame([(i, i % 3, [30, 6, 2][i % 3]) for i in range(90)] + [(100, 7, 1)], "peak_id long, cluster_label long, size long")
    assert {r.cluster_label for r in curation.trash_small(peaks, 1).collect()} == {0, 1, 2, -1}
    assert curation.new_label(peaks) == 8 and curation.new_label(peaks.filter("peak_id < 0")) == 0
    merged = curation.merge(peaks, [1, 2])
    assert {r.cluster_label: r.nb_peak for r in curation.label_sizes(merged).collect()} == {0: 30, 1: 60, 7: 1}
    c = spark.createDataFrame([(0, 0, "x"), (1, 0, "y")], "cluster_label long, cell_label long, tag string")
    assert curation.set_attribute(c, 1, tag="a" * 40).filter("cluster_label = 1").first().tag == "a" * 16


def test_whole_pipeline_recovers_events(spark):
    x, truth = recording(30_000, seed=8, gap=110)
    slow = 30 * np.sin(np.arange(30_000) / 2000)[:, None]
    probe = detect.default_geometry(spark, 0, [0, 1, 2, 3])
    p = pipeline.automatic(4, 15000.0, highpass=300.0, threshold=8.0, left_ms=-1.0, right_ms=1.3, min_cluster_size=15, block=6000)
    processed, noise = pipeline.process(from_arrays(spark, [x + slow]), p, noise_seconds=2.0)
    processed = processed.persist()
    assert noise.count() == 4
    c, peaks = pipeline.build_catalogue(processed, probe, p)
    spikes = peeling.peel_segments(processed, c).collect()
    assert 3 <= len(c.labels) <= 5
    found = sorted((r["index"], r.cluster_label) for r in spikes if r.cluster_label >= 0)
    named = [(k, label) for at, k in truth for i, label in found if abs(i - at) <= 3]
    assert len(named) > 0.9 * len(truth)
    pure = sum(max(sum(1 for t, m in named if m == label and t == k) for k in range(3)) for label in c.labels)
    assert pure > 0.95 * len(named)


def test_dip_by_group_takes_every_value(spark):
    r = np.random.default_rng(5)
    sets = {0: np.r_[r.normal(0, 1, 2900), r.normal(9, 0.2, 100)], 1: np.round(r.normal(0, 1, 700), 1)}
    df = spark.createDataFrame([(k, float(x)) for k, values in sets.items() for x in values], "cluster_label long, x double")
    got = {row.cluster_label: (row.dip, row.p) for row in clustering.dip_by_group(df, ["cluster_label"], "x", draws=5).collect()}
    assert got == {k: clustering.dip_test(values, 5) for k, values in sets.items()}


def test_k14_uses_all_values_and_1000_draws(spark, sf_dir, monkeypatch):
    from spindrift.plans import model_queries

    seen = []
    monkeypatch.setattr(clustering, "dip_by_group", lambda df, keys, value, draws=1000, **options: seen.append((draws, options)) or df.limit(0).selectExpr("cluster_label", "0D AS dip", "0D AS p"))
    model_queries.k14(spark, sf_dir)
    assert seen == [(1000, {})]


MIDDLE = "/root/testdata/sf0.01"


def test_s24_takes_every_spike_of_every_segment(spark):
    from spindrift.plans import event_queries

    events = spark.read.parquet(f"{MIDDLE}/events.parquet").select("event_id", "user_id", "value").collect()
    signal = {(e.event_id // 4096, e.event_id % 4096 // 8, e.event_id % 8): e.value - 245 for e in events}
    spikes = [(e.event_id // 4096, e.event_id * 37 % 4096 // 9, e.user_id % 6 % 3) for e in events]
    sums = {}
    for segment, index, unit in spikes:
        for shift in range(-3, 4):
            for channel in range(8):
                x = signal.get((segment, index + shift, channel))
                if x is not None:
                    total, n = sums.get((unit, shift, channel), (0.0, 0))
                    sums[unit, shift, channel] = total + x, n + 1
    place = {u: min((t / n, shift, c) for (v, shift, c), (t, n) in sums.items() if v == u)[1:] for u in range(3)}
    want = []
    for segment, index, unit in spikes:
        shift, channel = place[unit]
        x = signal.get((segment, index + shift, channel))
        if x is not None:
            want.append((segment, index + shift, channel, round(x, 4), unit))
    got = event_queries.s24(spark, MIDDLE).collect()
    assert sorted((r.segment, r["index"], r.channel, round(r.extremum_amplitude, 4), r.cluster_label) for r in got) == sorted(want)
    assert len({r.segment for r in got}) > 1


def test_f02_keeps_clear_of_every_spike(spark, sf_dir, monkeypatch):
    from spindrift.plans import model_queries

    seen = []
    monkeypatch.setattr(waveforms, "noise_positions", lambda lengths, peaks, *more: seen.append(peaks.count()))
    model_queries.f02(spark, sf_dir)
    assert seen == [spark.read.parquet(f"{sf_dir}/events.parquet").count()]


def test_queries_read_whole_tables():
    from spindrift.plans.registry import ORACLE_SQL, QUERIES

    for name in ("X13_prediction", "X13_residual", "J01_waveform_cut", "S10_point_lookup", "J07_overlap_triples", "C08_sorted_peaks"):
        assert name in QUERIES and not any(cut in ORACLE_SQL[name] for cut in ("% 37", "% 53", "% 10 ", "label < 5", "LIMIT"))


def test_auto_merge_joins_equal_clusters_alone(spark):
    """Clusters 0 and 1 are one shape, 2 has another size, 3 the same shape on channels that it does not share."""
    r = np.random.default_rng(4)
    shape = -8 * np.exp(-0.5 * ((np.arange(16) - 7) / 1.5) ** 2)
    rows = []
    for k, (channel, size) in enumerate([(0, 1.0), (0, 1.0), (0, 2.5), (3, 1.0)]):
        for i in range(60):
            x = r.normal(0, 0.5, (16, 4))
            x[:, channel] += size * shape
            rows.append((k * 100 + i, k, x.ravel().tolist()))
    waves = spark.createDataFrame(rows, "peak_id long, cluster_label long, wf array<double>")
    centres = waveforms.centroids(waveforms.long_form(waves, "peak_id", "wf", 4, "cluster_label"), "cluster_label")
    together = waveforms.shared_channels(waveforms.sparse_mask(centres, "cluster_label", 1.5), "cluster_label")
    assert [tuple(x) for x in clustering.auto_merge(waves, centres, together).collect()] == [(1, 0)]
    assert clustering.merge_pairs_in_order([(0, 2), (1, 2), (0, 1), (2, 3)]) == [(1, 0), (2, 0)]


def test_split_labels_are_new_and_trash_is_trash(spark):
    parts = spark.createDataFrame([(1, 4, 0), (2, 4, 1), (3, 4, -1), (4, 7, 0), (5, 7, 1), (6, 4, 2)], "peak_id long, cluster_label long, part long")
    assert dict(clustering.split_labels(parts).select("peak_id", "cluster_label").collect()) == {1: 4, 2: 8, 3: -1, 4: 7, 5: 10, 6: 9}


def test_clusters_of_a_selection_get_new_labels(spark):
    peaks = spark.createDataFrame([(i, i % 2) for i in range(40)], "peak_id long, cluster_label long")
    chosen = spark.createDataFrame([(i, [float(i % 4), 0.0]) for i in range(0, 40, 2)], "peak_id long, features array<double>")
    got = clustering.find_on_selection(peaks, chosen, "agglomerative", n_clusters=2).collect()
    assert {r.cluster_label for r in got if r.peak_id % 2} == {1} and {r.cluster_label for r in got if r.peak_id % 2 == 0} == {2, 3}


def test_samples_too_large_for_one_task_are_refused(spark):
    import pytest

    from spindrift.operators import metrics

    rows = spark.range(30).selectExpr("id", "array(cast(id as double)) AS features", "id % 2 AS label")
    with pytest.raises(ValueError, match="sample"):
        clustering.find_clusters(rows, "id", "dbscan", max_rows=20)
    with pytest.raises(ValueError, match="sample"):
        metrics.silhouette(rows, "id", "label", "features", max_points=20)


def test_spikes_from_files_and_report(spark, tmp_path):
    from spindrift.sources import export, importers

    (tmp_path / "run.params").write_text("[data]\nsampling_rate = 1000 # Hz\n[other]\nname = x\n")
    spark.createDataFrame([(3, 0.5), (4, 0.25)], "unit long, time double").write.csv(str(tmp_path / "spikes"), header=True)
    got = importers.from_files(spark, str(tmp_path / "spikes"), str(tmp_path / "run.params"), "csv", in_seconds=True)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 250, 4), (0, 500, 3)]
    clusters = spark.createDataFrame([(1, 5), (0, 7)], "cluster_label long, nb_spike long")
    paths = export.write_report(clusters, clusters.limit(1), str(tmp_path / "report"))
    assert [r.nb_spike for r in spark.read.csv(paths[0], header=True).collect()] == ["7", "5"]
