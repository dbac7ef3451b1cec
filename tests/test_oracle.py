"""Every query that has SQL, compared with DuckDB on the smallest data."""

from __future__ import annotations

from pathlib import Path

import pytest
from oracle_check import compare, connect

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = e.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(e.oracle_sql()[name])
    diff = compare(rows, df.columns, res.fetchall(), [c[0] for c in res.description])
    assert not diff, diff
    assert rows, "nothing was compared"


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    assert e.entry(spark).columns == ["fecha", "oee", "availability", "performance", "quality"]
