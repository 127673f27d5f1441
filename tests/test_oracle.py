"""Every query that has a SQL form gives what the SQL gives; every other one gives rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check_queries  # noqa: E402
from conftest import TESTDATA  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check_queries.views(TESTDATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert check_queries.compare(QUERIES[name](spark, TESTDATA), con.sql(ORACLES[name])) == []


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["station", "hour_start", "bucket_end", "cycle", "pos", "value"]
    assert df.count() > 0
