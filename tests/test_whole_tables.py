"""Clustering of whole tables gives the labels of the kernels on one sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import clustering, density, graph, hierarchy, linkage, modes, neighbours


def blobs(n: int, seed: int = 1, d: int = 4) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = ((0, 1.0), (4, 0.7), (-5, 0.3), (9, 1.2))
    x = np.concatenate([r.normal(c, s, (n // 6, d)) for c, s in centres] + [r.uniform(-9, 12, (n - 4 * (n // 6), d))])
    r.shuffle(x)
    return x


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")


def labels(df, n):
    rows = df.collect()
    assert len(rows) == n
    got = {r.id: r.cluster_label for r in rows}
    return np.array([got[i] for i in range(n)])


def test_dbscan_equals_the_kernel(spark):
    x = blobs(5000)
    assert (labels(density.dbscan_table(table(spark, x), "id", eps=1.0, min_samples=6, piece=700), 5000) == clustering.dbscan(x, 1.0, 6)).all()


def test_dbscan_compares_points_of_different_parts_only(spark, monkeypatch):
    """Points of one dense cluster met in all pairs before; where outermost points do not link parts that belong together, others do."""
    met = {}

    def counted(units, key, kernel, schema, run=density.in_units):
        met[kernel.__name__] = units.count()
        return run(units, key, kernel, schema)

    monkeypatch.setattr(density, "in_units", counted)
    dense = np.random.default_rng(5).uniform(0, 0.9, (3000, 3))
    assert (labels(density.dbscan_table(table(spark, dense), "id", eps=1.0), 3000) == 0).all()
    assert met["linked"] < 1000 and met["crossed"] == 0, met
    sparse = np.random.default_rng(6).uniform(0, 30, (2000, 2))
    for eps in (0.7, 0.9, 1.2):
        want = clustering.dbscan(sparse, eps, 4)
        assert (labels(density.dbscan_table(table(spark, sparse), "id", eps=eps, min_samples=4, piece=300), 2000) == want).all()


def plain_hdbscan(x, least):
    """Top down: all edges of the largest weight go at once, parts of at least `least` rows are clusters when there are two or more of them."""
    d = neighbours.gaps(x, x)
    core = np.sort(d, axis=1)[:, least - 1]
    tree = clustering.spanning_tree(np.maximum(np.maximum(core[:, None], core[None]), d))
    out = np.full(len(x), -1)

    def parts(nodes, edges):
        at = {n: i for i, n in enumerate(nodes)}
        roots = clustering._roots(len(nodes), [(at[a], at[b]) for a, b, _ in edges])
        found = {}
        for n, r in zip(nodes, roots.tolist(), strict=True):
            found.setdefault(r, ([], []))[0].append(n)
        for e in edges:
            found[roots[at[e[0]]]][1].append(e)
        return list(found.values())

    def walk(nodes, edges, born):
        stability, left = 0.0, (nodes, edges)
        while True:
            nodes, edges = left
            top = max((e[2] for e in edges), default=0)
            density = 1 / top if top else 1e12
            pieces = parts(nodes, [e for e in edges if e[2] < top])
            big = [p for p in pieces if len(p[0]) >= least]
            if len(big) == 1:
                stability += (len(nodes) - len(big[0][0])) * (density - born)
                left = big[0]
                continue
            return stability + len(nodes) * (density - born), [(p[0], *walk(*p, density)) for p in big]

    def best(nodes, stability, below):
        inner = [best(*k) for k in below]
        total = sum(k[0] for k in inner)
        return (total, [c for k in inner for c in k[1]]) if below and total > stability else (stability, [nodes])

    found = [c for k in walk(list(range(len(x))), tree, 0.0)[1] for c in best(*k)[1]]
    for c in found:
        out[c] = min(c)
    return clustering._numbered(out)


def test_hdbscan_equals_the_plain_form_and_the_kernel(spark):
    x = blobs(3000)
    got = labels(linkage.hdbscan_table(table(spark, x), "id", min_cluster_size=20, piece=600, pivots=64), 3000)
    assert (got == plain_hdbscan(x, 20)).all() and got.max() >= 3
    assert (got != clustering.hdbscan(x, 20)).sum() <= 3  # rows at the weight at which clusters meet


def test_hdbscan_in_bands_of_edges(spark):
    x = np.round(blobs(500, 3), 1)  # many ties
    got = linkage.hdbscan_table(table(spark, x), "id", min_cluster_size=10, piece=150, pivots=20, band=120)
    assert (labels(got, 500) == plain_hdbscan(x, 10)).all()


def test_noise_rows_take_part_and_are_left_out(spark):
    x, noise = blobs(300, 4, 3), np.random.default_rng(5).uniform(-9, 12, (200, 3))
    extra = spark.createDataFrame([(v.tolist(),) for v in noise], "features array<double>")
    got = labels(clustering.find_clusters(table(spark, x), "id", "dbscan_with_noise", noise=extra, whole=True, min_cluster_size=15), 300)
    want = clustering._numbered(plain_hdbscan(np.concatenate([x, noise]), 15)[:300])
    assert (got == want).all()


def test_ward_equals_the_kernel(spark):
    x = blobs(2000)
    got = hierarchy.ward_table(table(spark, x), "id", n_clusters=7, last=1200, pivots=64, piece=500)
    assert (labels(got, 2000) == clustering.agglomerative(x, 7)).all()


def test_mean_shift_equals_the_kernel(spark):
    x = blobs(300, 2, 2)
    assert (labels(modes.mean_shift_table(table(spark, x), "id", bandwidth=2.5, piece=100), 300) == clustering._numbered(clustering.meanshift(x, 2.5))).all()


WHOLE = [("dbscan", {"eps": 1.0}), ("hdbscan", {"min_cluster_size": 5}), ("agglomerative", {"n_clusters": 3}), ("meanshift", {"bandwidth": 1.5})]


@pytest.mark.parametrize(("method", "options"), WHOLE)
def test_odd_rows(spark, method, options):
    """A third of all rows at one place, null ids and vectors, nulls and NaN in vectors, repeated rows, columns of clashing names."""
    rows = [(i, [0.0, 0.0]) for i in range(20)] + [(20 + i, [5.0 + i % 5 / 10, 5.0]) for i in range(20)] + [(40 + i, [9.0, -9.0 + i % 4 / 10]) for i in range(12)]
    odd = [(90, None), (91, [None, 1.0]), (92, [float("nan"), 1.0]), (93, []), (5, [0.0, 0.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame([*rows, *odd], "id long, features array<double>")
    for name in ("_id", "_x", "_cell", "_unit", "_left", "_cluster", "_label", "_core", "cluster_label"):
        df = df.withColumn(name, F.lit("extra"))
    got = clustering.find_clusters(df, "id", method, whole=True, **options).collect()
    assert len(got) == len(rows) + len(odd)
    of = {r.id: r.cluster_label for r in got}
    assert [of[i] for i in (90, 91, 92, 93)] == [-1] * 4
    assert [{of[i] for i in part} for part in (range(20), range(20, 40), range(40, 52))] == [{0}, {1}, {2}]


@pytest.mark.parametrize(("method", "options"), WHOLE)
def test_empty_and_few_rows(spark, method, options):
    empty = spark.createDataFrame([], "id long, features array<double>")
    assert clustering.find_clusters(empty, "id", method, whole=True, **options).count() == 0
    one = spark.createDataFrame([(7, [1.0, 2.0])], "id long, features array<double>")
    (r,) = clustering.find_clusters(one, "id", method, whole=True, first=4, **options).collect()
    assert (r.id, r.cluster_label) == (7, 4 if method in ("agglomerative", "meanshift") else -1)


def test_whole_and_keys_exclude_each_other(spark):
    df = table(spark, blobs(12))
    with pytest.raises(ValueError):
        clustering.find_clusters(df, "id", "dbscan", keys=["id"], whole=True)
    with pytest.raises(ValueError):
        clustering.find_clusters(df, "id", "optics", whole=True)


def test_neighbours_are_exact(spark):
    x = blobs(600, 6)
    points = table(spark, x).select(F.col("id").alias("_id"), F.col("features").alias("_x"))
    cores, near = neighbours.k_nearest(points, 7, neighbours.Pivots(points, 20), piece=90)
    d = neighbours.gaps(x, x)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, 6]
    assert all(r._core == want[r._id] for r in cores.collect())
    assert near.count() == 600 * 7


def test_components_and_numbers(spark):
    links = spark.createDataFrame([(9, 8), (8, 3), (5, 6), (6, 5), (4, 4), (12, 3), (30, 29), (29, 28), (28, 27), (27, 26)], "a long, b long")
    assert {r.node: r.component for r in graph.components(links).collect()} == {3: 3, 8: 3, 9: 3, 12: 3, 5: 5, 6: 5, **dict.fromkeys(range(26, 31), 26)}
    values = spark.range(0, 5000, 7).select((F.col("id") * 3).alias("v"))
    got = graph.numbered(values, "v", "n", bucket=100).collect()
    assert sorted((r.v, r.n) for r in got) == [(3 * v, i) for i, v in enumerate(range(0, 5000, 7))]


def test_ward_in_cells_equals_the_kernel_in_few_rounds(spark, monkeypatch):
    x = blobs(2000)
    x[50:80] = x[7]  # equal points
    rounds, each = [], hierarchy.contracted

    def counted(clusters, n, *more):
        rounds.append(n)
        return each(clusters, n, *more)

    monkeypatch.setattr(hierarchy, "contracted", counted)
    monkeypatch.setattr(hierarchy, "nearest_clusters", None)  # no round over all pairs is needed
    got = hierarchy.ward_table(table(spark, x), "id", n_clusters=7, last=500, piece=300, cell=400)
    assert (labels(got, 2000) == clustering.agglomerative(x, 7)).all()
    assert 1 < len(rounds) <= 5
