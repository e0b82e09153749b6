from __future__ import annotations

import pytest
from oracle import SF, assert_same, connect

from tidewell.plans import registry as q


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    assert_same(spark, con, q.QUERIES[name], q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_runs(spark, name):
    df = q.QUERIES[name](spark, SF)
    assert all(len(r) == len(df.columns) for r in df.collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
