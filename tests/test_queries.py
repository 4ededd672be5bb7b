"""Every registered query against its checking SQL."""

from __future__ import annotations

import os

import compare
import pytest

import __spark_entry__ as entry
from feedloom.plans import ORACLES, QUERIES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
ROWS_ONLY = {"language_model_eval"}


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_every_query_has_a_check():
    assert set(ORACLES) == set(QUERIES) - ROWS_ONLY
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    columns, got = compare.spark_rows(entry.queries()[name](spark, SF_DIR))
    want_columns, want = compare.oracle_rows(duck, entry.oracle_sql()[name])
    assert columns == want_columns
    assert got == want


def test_language_model_is_mostly_right(spark):
    rows = entry.queries()["language_model_eval"](spark, SF_DIR).collect()
    right = sum(r.n for r in rows if r.lang == r.predicted)
    assert right >= 0.9 * sum(r.n for r in rows)


def test_entry(spark):
    assert entry.entry(spark).columns == ["language", "n"]
