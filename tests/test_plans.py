"""Shape of the physical plans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from feedloom.operators import merge
from feedloom.plans import articles, feeds, jobs
from feedloom.plans.registry import table
from feedloom.session import cut_lineage

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_python_no_cross_join_no_global_window(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    for operator in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan
    for line in plan.splitlines():
        if re.search(r"[+:]- Window ", line):
            assert "windowspecdefinition(" in line and not re.search(r"windowspecdefinition\([^,()]* (ASC|DESC)", line)


def test_groups_are_cut_into_chunks(spark):
    """The rows of one feed travel by feed and chunk; only chunk summaries meet per feed."""
    plan = plan_of(feeds.feed_runtime(spark, SF_DIR))
    assert re.search(r"hashpartitioning\(feed_id#\d+L, _chunk#\d+L", plan)
    by_feed = plan.index("Exchange hashpartitioning(feed_id#", 0)
    assert "SortAggregate" in plan[by_feed : plan.index("_chunk", by_feed + 60)]


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(jobs.job_progress(spark, SF_DIR))
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan
    articles_table = table(spark, SF_DIR, "documents").select(F.col("lang").alias("language"))
    from feedloom.functions.language import is_unknown

    plan = plan_of(articles_table.where(is_unknown(F.col("language"))))
    assert "PushedFilters: [Or(IsNull(lang),In(lang, [,xx]))]" in plan


def test_store_rows_are_filtered_by_a_bounded_broadcast(spark, monkeypatch):
    from feedloom.operators import skew

    resolved = articles.batch_candidates(table(spark, SF_DIR, "documents")).withColumn("resolved_key", F.col("article_key"))
    resolved = resolved.withColumn("is_root", F.lit(True))
    stored = cut_lineage(articles.stored_articles(spark, SF_DIR))
    few = merge.changed_articles(stored, resolved, F.current_timestamp())
    assert "BroadcastHashJoin" in plan_of(few) and "LeftSemi" in plan_of(few)
    monkeypatch.setattr(skew, "MAX_BROADCAST_BYTES", 100)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else the planner would broadcast by its own estimate
    try:
        many = merge.changed_articles(stored, resolved, F.current_timestamp())
        shuffled = plan_of(many)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert re.search(r"SortMergeJoin[^\n]*LeftSemi", shuffled) and "BroadcastHashJoin" not in shuffled
    assert sorted(map(str, few.drop("ingested_at").collect())) == sorted(map(str, many.drop("ingested_at").collect()))
