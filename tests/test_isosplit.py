import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import clustering, isosplit


def test_pooled_is_the_best_rising_fit():
    r = np.random.default_rng(1)
    for _ in range(50):
        y = r.normal(0, 1, 12)
        fit, errors = isosplit.pooled(y)
        assert (np.diff(fit) >= -1e-12).all() and abs(errors[-1] - ((fit - y) ** 2).sum()) < 1e-9
        # by the formula of largest means that begin before and smallest that end behind
        want = [max(min(y[a : b + 1].mean() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(fit, want)


def test_cuts_two_modes_alone():
    r = np.random.default_rng(2)
    for n in (200, 2000, 50_000):
        one = np.histogram(r.normal(0, 1, n), isosplit.BINS)[0]
        flat = np.histogram(r.uniform(0, 1, n), isosplit.BINS)[0]
        skew = np.histogram(r.exponential(1, n), isosplit.BINS)[0]
        assert [isosplit.iso_cut(c) for c in (one, flat, skew)] == [None] * 3
        counts, edges = np.histogram(np.r_[r.normal(0, 1, n), r.normal(6, 1, n // 3)], isosplit.BINS)
        assert 1.5 < edges[isosplit.iso_cut(counts)] < 4.8


def test_planted_mixture(spark):
    """Clusters of unlike sizes and shapes, one of them long, are found as they are."""
    r = np.random.default_rng(3)
    parts = [r.normal(0, 1, (400, 3)), r.normal(0, 1, (120, 3)) + [8, 0, 0], r.normal(0, 1, (300, 3)) * [0.5, 6, 0.5] + [-9, 0, 0], r.normal(0, 0.4, (80, 3)) + [0, 9, 5]]
    x, truth = np.concatenate(parts), np.repeat(range(4), [len(p) for p in parts])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = {q.id: q.cluster_label for q in clustering.find_clusters(df, "id", "isosplit5", whole=True, parcels=12).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert found.max() == 3 and (found == truth).mean() > 0.99


def test_odd_rows(spark):
    rows = [(i, [0.0, 0.0]) for i in range(40)] + [(90, None), (91, [None, 1.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, features array<double>").withColumn("_k", F.lit("extra"))
    got = isosplit.iso_split_table(df, "id").collect()
    assert len(got) == 43 and {r.cluster_label for r in got if r.id < 90} == {0} and {r.cluster_label for r in got if r.id >= 90} == {-1}
    assert isosplit.iso_split_table(df.limit(0), "id").count() == 0
