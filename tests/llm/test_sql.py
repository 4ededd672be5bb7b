"""The text queries that have SQL against it."""

from __future__ import annotations

import compare
import pytest

from feedloom.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    columns, got = compare.spark_rows(QUERIES[name](spark, SF_DIR))
    assert (columns, got) == compare.oracle_rows(duck, ORACLES[name])
