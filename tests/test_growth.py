"""What must not grow with the input: memory of a task, rows sent to the driver, passes over a table."""

from __future__ import annotations

import pytest

from feedloom.operators import jobs as J


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_outcome_texts_are_not_sorted(spark):
    claims = spark.createDataFrame([(1, 5, "processing", None, 7), (2, 5, "processing", None, 9)], "task_id long, execution_id long, status string, claim_expires_at timestamp, item_total long")
    rows = [(1, 1, 5, "failed", "x" * 3000), (2, 1, 5, "failed", "late"), (3, 2, 4, "failed", "stale"), (4, 2, 5, "completed", "none"), (5, 3, 5, "failed", "unknown"), (None, 2, 5, "failed", "no seq"), (1, 1, 5, "failed", "twin")]
    reports = spark.createDataFrame(rows, "seq long, task_id long, execution_id long, outcome string, error_message string").selectExpr("*", "timestamp'2024-01-01' AS at", "1L AS item_success", "2L AS item_error")
    done = J.task_outcomes(reports, claims)
    assert "SortMergeJoin" not in plan_of(done)
    found = sorted(((r.seq, r.verdict, r.last_error and r.last_error[:4], r.last_error and len(r.last_error)) for r in done.collect()), key=str)
    want = [(1, "accepted", "twin", 4), (1, "accepted", "xxxx", 2000), (2, "not_processing", None, None), (3, "stale_execution", None, None), (4, "accepted", None, None), (5, "unknown_task", None, None), (None, "not_processing", None, None)]
    assert found == sorted(want, key=str)


def test_rounds_of_sets_broadcast_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    from feedloom.operators import resolve, resultsets
    from feedloom.session import cut_lineage

    plans = []

    def spy(df, root=None):
        plans.append(plan_of(df))
        return cut_lineage(df, root)

    monkeypatch.setattr(resultsets, "cut_lineage", spy)
    monkeypatch.setattr(resolve, "cut_lineage", spy)
    rows = [(0, 0, "a", "x"), (1, 0, "b", "x"), (2, 1, "b", "y"), (3, 1, "c", None), (4, 2, "d", "x")]
    batch = cut_lineage(spark.createDataFrame(rows, "seq long, set_id long, article_key string, content_key string").withColumn("published_at", F.lit(None).cast("timestamp")))
    known = cut_lineage(spark.createDataFrame([("c", "y")], "article_key string, content_key string").selectExpr("*", "timestamp'2024-01-01' AS published_at", "timestamp'2024-01-02' AS ingested_at"))
    done = resultsets.resolve_sets(batch, known, F.lit("2024-02-01").cast("timestamp"))
    plans.append(plan_of(done))
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]
    assert sorted((r.seq, r.resolved_key, r.is_root) for r in done.collect()) == [(0, "a", True), (1, "a", False), (2, "c", True), (3, "c", False), (4, "a", True)]


def test_lookup_of_most_keys_asks_no_filters(spark, tmp_path, monkeypatch):
    from feedloom.sources import keyindex
    from feedloom.sources.partitioned import PartitionedTable

    table = PartitionedTable(spark, str(tmp_path / "t"), ["id"], "id STRING, n BIGINT", 4, indexed=True)
    rows = spark.range(20000).selectExpr("cast(id AS string) AS id", "id AS n")
    table.write(rows, 1)
    table.write(rows.where("n % 2 = 0").selectExpr("id", "-n AS n"), 2)
    asked = []
    hits = PartitionedTable._hits
    monkeypatch.setattr(PartitionedTable, "_hits", lambda self, *a: asked.append(1) or hits(self, *a))
    found = table.lookup(rows.where("n % 3 = 0").unionByName(spark.createDataFrame([("none", 1), (None, 2)], "id string, n long")))
    assert found.agg({"n": "sum", "id": "count"}).first().asDict() == {"sum(n)": sum(-n if n % 2 == 0 else n for n in range(0, 20000, 3)), "count(id)": 6667}
    assert not asked
    assert table.lookup(spark.createDataFrame([("4",)], "id string")).collect()[0].n == -4
    assert asked
    # The rows are grouped once, not once for each hash.
    plan = plan_of(keyindex.build(spark.range(9).selectExpr("id", "0 AS part"), ["id"], 2))
    assert plan.index("Generate") < plan.rindex("bitmap_construct_agg")


def test_task_batches_read_the_tasks_once(spark):
    from feedloom.plans.jobs import task_batches

    rows = spark.createDataFrame([("1-1-4-2", 1, "failed", 5, 6), ("1-1-4-2", 1, "pending", 5, 6)], "task_id string, job_id long, status string, item_success long, item_error long").selectExpr("*", "date'2024-01-01' AS requested_at")
    batches = task_batches(rows)
    assert not [b for b in batches if "Aggregate" in plan_of(b)]
    assert [sorted((r.seq, r.status) for r in b.collect()) for b in batches] == [[(1, "pending")], [(2, "processing"), (3, "failed")], [(4, "pending")]]
