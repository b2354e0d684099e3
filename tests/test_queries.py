"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import compare, duck


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, small, con, name):
    got = entry.queries()[name](spark, small).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        assert compare(got, con.execute(sql).df()) == ""


def test_entry_returns_one_metrics_row(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["information_ratio"] is not None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
