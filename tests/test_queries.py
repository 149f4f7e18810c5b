"""Every registered query against its checking SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from oracle import compare, duck

QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="session")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf, con):
    note, _, ok = compare(name, spark, sf, con, QUERIES, ORACLE)
    assert ok, note


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert "target_leak_horizon" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
