"""The registered queries on texts against their SQL twins."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from barloom.llm import queries
from tests.oracle import assert_same, run_sql

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.queries())
    assert numbers == list(range(1, 14))
    assert set(queries.queries()) | {"pipeline"} <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    actual = queries.queries()[name](spark, SF).toPandas()
    assert len(actual) > 0
    assert_same(actual, run_sql(queries.oracle_sql()[name], SF))
