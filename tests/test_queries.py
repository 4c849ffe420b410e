from __future__ import annotations

import pytest

from mapquarry.plans import landed  # noqa: F401  registers its queries
from mapquarry.plans.queries import QUERIES
from mapquarry.plans.sql import SQL
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    assert_same(spark, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 20
    assert set(e.oracle_sql()) <= set(e.queries())
