"""Every registered query runs on whole tables; those with SQL must agree with it."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    ok, message = compare(QUERIES[name](spark, SF), duck, ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    report = entry.entry(spark)
    assert "top_terms" in report.columns and report.count() > 0
