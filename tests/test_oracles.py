"""Every registered query of the library runs; those with SQL give the same rows."""

import pytest

from spindrift.plans.registry import ORACLE_SQL, QUERIES

from .oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert differences(df, con, ORACLE_SQL[name]) == []
    else:
        assert df.columns and df.count() >= 0
