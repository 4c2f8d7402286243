"""Whole jobs of growing tables: the same results in tasks of bounded size."""

import inspect
import io
import tracemalloc
import zipfile

import numpy as np
from pyspark.sql import functions as F

from spindrift.operators import clustering, leaves, linkage, metrics, neighbours, reachability, shears, trains
from spindrift.sources import export

from .test_whole_tables import blobs, labels, table


def test_dip_of_counts_and_of_samples_drawn_alone(spark):
    r = np.random.default_rng(3)
    g = np.random.default_rng(0)
    samples = [g.uniform(size=500) for _ in range(4)]
    assert [clustering.null_dip(500, k) for k in range(4)] == [clustering.dip(x) for x in samples]
    x = np.r_[r.normal(size=3000), r.normal(6, 1, size=2000)].round(1)
    values, counts = np.unique(x, return_counts=True)
    assert clustering.dip(x) == clustering.dip(values[::-1], counts[::-1])
    groups = {0: x[:300], 1: r.uniform(size=300), 2: np.array([1.0, 2.0, 2.0, 3.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, values in groups.items() for v in values], "k long, v double")
    found = {r["k"]: (r["dip"], r["p"]) for r in clustering.dip_by_group(rows, ["k"], "v", draws=50).collect()}
    assert found == {k: clustering.dip_test(values, 50) for k, values in groups.items()}


def test_optics_of_a_table_equals_the_kernel(spark):
    x = blobs(1500)
    rows = table(spark, x)
    for options in ({}, {"eps": 0.8}, {"max_eps": 1.5, "min_samples": 8}):
        assert (labels(reachability.optics_table(rows, "id", piece=500, pivots=20, **options), 1500) == clustering.optics(x, **options)).all()


def test_pruning_shears_of_a_table_equal_the_kernel(spark):
    r = np.random.default_rng(4)
    peak = r.integers(0, 3, 900)
    x = r.normal(size=(900, 12)) * 0.3
    for c in range(3):
        x[peak == c, 4 * c : 4 * c + 4] += np.where(r.random((peak == c).sum()) < 0.5, 6.0 + c, 11.0 + c)[:, None]
    channel_of, adjacent, top = np.repeat(np.arange(3), 4), np.eye(3, dtype=bool), np.abs(x).max(1)
    rows = spark.createDataFrame([(i, v.tolist(), int(p), float(a)) for i, (v, p, a) in enumerate(zip(x, peak, top, strict=True))], "id long, x array<double>, peak int, amp double")
    got = shears.pruning_shears_table(rows, "id", "x", channel_of, "peak", "amp", adjacent, 20, sample=600)
    want = clustering.pruning_shears(x, channel_of, peak, top, adjacent, 20)
    assert want.max() >= 4 and (labels(got, 900) == want).all()


def test_hdbscan_on_leaves_equals_the_merged_edges_of_a_matrix():
    r = np.random.default_rng(0)
    for turn in range(24):
        n, least = int(r.integers(30, 700)), int(r.integers(2, 15))
        x = np.r_[r.normal(size=(n, 3)), r.normal(size=(n // 2, 3)) * 0.3 + 4, np.repeat(r.normal(size=(3, 3)), n // 9, 0)]
        x = x.round(1) if turn % 3 == 0 else x  # many equal weights
        d = neighbours.gaps(x, x)
        core = np.partition(d, least - 1, axis=1)[:, least - 1]
        edges = clustering.spanning_tree(np.maximum(np.maximum(core[:, None], core[None]), d))
        _, closed, fell = linkage.merged([(w, i, a, b) for i, (a, b, w) in enumerate(edges)], {i: (1, None, 0.0, 0, None) for i in range(len(x))}, least)
        up = {c: (parent, chosen) for c, parent, chosen in closed}

        def top(c, up=up):
            best = -1
            while c in up:
                best, c = c if up[c][1] else best, up[c][0]
            return best

        want = clustering._numbered(np.array([top(fell.get(i)) for i in range(len(x))]))
        assert (leaves.hdbscan(x, least) == want).all()


def test_ten_thousand_peaks_are_clustered_without_a_matrix():
    x = np.random.default_rng(1).normal(size=(10_000, 3))
    x[:4000] = x[:4000] * 0.2 + 5
    x[9000:] = x[9000]  # one vector of a thousand rows
    tracemalloc.start()
    found = leaves.hdbscan(x, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and found[9000:].max() == found[9000:].min() >= 0  # a matrix of 800 MB before


def test_visits_of_shears_in_one_task_and_by_spark_keep_the_labels(spark):
    r = np.random.default_rng(4)
    peak = r.integers(0, 3, 900)
    x = r.normal(size=(900, 12)) * 0.3
    for c in range(3):
        x[peak == c, 4 * c : 4 * c + 4] += np.where(r.random((peak == c).sum()) < 0.5, 6.0 + c, 11.0 + c)[:, None]
    channel_of, adjacent, top = np.repeat(np.arange(3), 4), np.abs(np.subtract.outer(np.arange(3), np.arange(3))) <= 1, np.abs(x).max(1)
    rows = spark.createDataFrame([(i, v.tolist(), int(p), float(a)) for i, (v, p, a) in enumerate(zip(x, peak, top, strict=True))], "id long, x array<double>, peak int, amp double")
    want = clustering.pruning_shears(x, channel_of, peak, top, adjacent, 20, cluster=leaves.hdbscan)
    assert want.max() >= 4
    for options in ({"sample": 60}, {"sample": 60, "peaks_at_once": 800}, {"sample": 60, "peaks_at_once": 850, "reduced_at_once": 60}):
        got = shears.pruning_shears_table(rows, "id", "x", channel_of, "peak", "amp", adjacent, 20, **options)
        assert (labels(got, 900) == want).all(), options
    # what was tired and has no fewer peaks is not clustered again
    seen = []

    def cluster(v, least):
        seen.append(v.tobytes())
        return leaves.hdbscan(v, least)

    clustering.pruning_shears(x, channel_of, peak, top, adjacent, 20, cluster=cluster)
    assert len(seen) == len(set(seen))


def test_silhouettes_in_units_equal_all_pairs(spark):
    x = np.r_[blobs(900, 3), blobs(900, 3)[:40], np.zeros((30, 4)), np.zeros((30, 4))]
    label = np.r_[np.random.default_rng(2).integers(0, 4, 930), np.full(5, 9), np.full(5, 8), np.full(30, 5), np.full(30, 6)]
    d, want = neighbours.gaps(x, x), np.zeros(len(x))
    mean = {k: d[:, label == k].sum(1) / (label == k).sum() for k in np.unique(label)}
    for i, k in enumerate(label):
        n = (label == k).sum()
        a, b = mean[k][i] * n / (n - 1), min(m[i] for q, m in mean.items() if q != k)
        want[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0
    rows = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x, strict=True))], "id long, label int, x array<float>")
    rows64 = rows.withColumn("x", F.col("x").cast("array<double>"))
    for df, near in ((rows, 1e-5), (rows64, 1e-5)):
        got = {r.id: r.silhouette for r in metrics.silhouette(df, "id", "label", "x").collect()}
        assert inspect.signature(metrics.silhouette).parameters["max_points"].default is None
        assert len(got) == len(x) and max(abs(got[i] - want[i]) for i in range(len(x))) < near


def test_correlograms_count_without_pairs(spark):
    r = np.random.default_rng(6)
    rows = [(i // 2, int(r.integers(0, 2)), int(t), [None, 0, 1, 2][r.integers(0, 4)]) for i, t in enumerate(r.integers(0, 400, 1500))]
    events = spark.createDataFrame(rows, "id long, seg int, t long, label long")
    want: dict = {}
    for i, s, t, a in rows:
        for j, s2, t2, b in rows:
            if s == s2 and 0 <= t2 - t <= 39 and (t2 > t or j > i) and ((t2 - t) // 10 or a != b):
                want[a, b, (t2 - t) // 10] = want.get((a, b, (t2 - t) // 10), 0) + 1
    want = {k: v for k, v in want.items() if None not in k}
    found = trains.cross_correlograms(events, "t", "label", "seg", "id", 1.0, 60.0, 10.0, dense=False)
    assert {(r.label_i, r.label_j, r.bin): r["count"] for r in found.collect() if None not in (r.label_i, r.label_j)} == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_the_tree_hold_a_bounded_part():
    assert linkage.BAND <= 100_000 and linkage.TILE * neighbours.PIECE * 8 <= 8 << 20 and neighbours.TILE <= 512


def test_xlsx_is_written_as_its_rows_go_by():
    tracemalloc.start()
    data = export.xlsx({"spikes": (["index", "label"], ((i, i % 7) for i in range(200_000)))})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20, peak
    sheet = zipfile.ZipFile(io.BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row ") == 200_001 and '<row r="200001"><c r="A200001"><v>199999</v></c><c r="B200001"><v>2</v></c></row></sheetData>' in sheet


def test_large_clusters_are_split_as_tables(spark):
    r = np.random.default_rng(8)
    x = {0: np.r_[r.normal(size=(150, 3)), r.normal(9, 1, (150, 3))], 1: r.normal(size=(250, 3)), 2: np.r_[r.normal(size=(40, 3)), r.normal(9, 1, (40, 3))]}
    rows = [(1000 * k + i, k, v.tolist()) for k, m in x.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "id long, cluster_label int, features array<double>")
    whole, tables = ({(q.id, q.cluster_label): q.part for q in clustering.auto_split(df, "id", sample=n).collect()} for n in (4096, 100))
    assert whole == tables and len(whole) == 630 and {whole[i, 0] for i in range(300)} >= {0, 1} and {whole[1000 + i, 1] for i in range(250)} == {0}
