"""The registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_point
from oracle_check import compare, duck

SMALL = entry_point.SMALL
ORACLES = entry_point.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_statement_belongs_to_a_query():
    assert set(ORACLES) <= set(entry_point.queries())


def test_flagship_query(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["series", "yr", "mo", "avg_mw", "avg_mw_prev_year", "yoy_pct"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(entry_point.queries()[name](spark, SMALL), con, ORACLES[name]) is None
