"""Every query with a SQL twin must agree with DuckDB; rows-only queries must return rows."""

import pytest

import __spark_entry__ as entry
from tests.conftest import ROOT
from tests.twin import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_twin(spark, con, name):
    msg, _ = compare(spark, con, ROOT, QUERIES[name], SQL[name])
    assert msg == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_rows(spark, name):
    assert len(QUERIES[name](spark, ROOT).take(1)) == 1


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["section", "subject", "metric", "value"] and df.count() > 0
