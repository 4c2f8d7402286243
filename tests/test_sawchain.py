import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import sawchain


def table(spark, amps):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(amps)], "id long, amps array<double>")


def labels(df):
    return {r.id: r.cluster_label for r in df.collect()}


def test_ripples_are_one_bump():
    x = np.arange(0, 30, sawchain.STEP)
    plain = np.exp(-0.5 * ((x - 15) / 4) ** 2)
    rippled = plain * (1 + 0.08 * np.sin(3 * x))
    for d in (plain, rippled):
        assert len(sawchain.bumps(d / d.sum() / sawchain.STEP, 1000, 20, 0.3)) == 1
    two = plain + np.exp(-0.5 * ((x - 26) / 1) ** 2)
    assert len(sawchain.bumps(two / two.sum() / sawchain.STEP, 1000, 20, 0.3)) == 2
    assert len(sawchain.bumps(two / two.sum() / sawchain.STEP, 30, 20, 0.3)) == 1  # too few rows for two


def test_planted_amplitudes(spark):
    r = np.random.default_rng(2)
    amps = np.abs(r.normal(0, 1, (500, 3)))
    amps[:100, 0] += 25
    amps[100:200, 0] += 14
    amps[200:300, 1] += 18
    amps[300:400, 2] += 12
    found = labels(sawchain.saw_chain_table(table(spark, amps), "id", "amps", 5.0))
    parts = [{found[i] for i in range(100 * k, 100 * k + 100)} for k in range(5)]
    assert all(len(p) == 1 for p in parts) and parts[4] == {-1} and len(set.union(*parts)) == 5


def test_rippled_density_gives_one_class(spark):
    """A class whose amplitudes come in many small steps is not cut."""
    r = np.random.default_rng(3)
    amps = np.zeros((900, 1))
    amps[:600, 0] = 20 + np.round(r.normal(0, 2, 600) / 1.5) * 1.5
    found = labels(sawchain.saw_chain_table(table(spark, amps), "id", "amps", 5.0))
    assert {found[i] for i in range(600)} == {0} and {found[i] for i in range(600, 900)} == {-1}


def test_many_cuts_keep_conditions_short(spark, monkeypatch):
    monkeypatch.setattr(sawchain, "CHAIN", 2)
    r = np.random.default_rng(4)
    amps = np.concatenate([r.normal(12 + 12 * k, 1, (60, 1)) for k in range(6)])
    found = labels(sawchain.saw_chain_table(table(spark, amps), "id", "amps", 5.0))
    parts = [{found[i] for i in range(60 * k, 60 * k + 60)} for k in range(6)]
    assert all(len(p) == 1 for p in parts) and len(set.union(*parts)) == 6 and min(set.union(*parts)) >= 0


def test_close_classes_are_merged_to_a_fixed_point(spark):
    """0 and 1 are close, and 2 is close to what they are together; 3 is far from all; trash stays trash."""
    rows = [(i, 0, [0.0] * 4) for i in range(5)] + [(5 + i, 1, [1.5] * 4) for i in range(30)] + [(40 + i, 2, [3.4] * 4) for i in range(9)] + [(60, 3, [50.0] * 4), (61, -1, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, cluster_label long, wf array<double>")
    got = labels(sawchain.merge_close(df.select("id", "cluster_label"), df.select("id", "wf"), "id", "wf", 2, 2.0))
    assert {got[i] for i in (*range(35), *range(40, 49))} == {0} and got[60] == 3 and got[61] == -1


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [None, 3.0]), (3, [])]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, "id long, amps array<double>").withColumn("_a", F.lit("extra"))
    got = sawchain.saw_chain_table(df, "id", "amps", 5.0).collect()
    assert len(got) == len(rows) and all(r.cluster_label == -1 for r in got)
