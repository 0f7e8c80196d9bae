"""Every query with a SQL twin gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as contract
from checks.compare import compare, connect
from checks.oracles import oracles
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
SQL = oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names():
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"score_with_pipeline"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict = compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert verdict.startswith(("ok", "rows only")), verdict
    assert "TYPES" not in verdict, verdict


def test_entry(spark):
    assert contract.entry(spark).count() == 1
