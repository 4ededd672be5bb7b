"""Queries on jobs, tasks, workers and leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import jobs as J
from feedloom.operators import workers as W
from feedloom.functions.keys import clean_ref_ids, parse_payload_ref, payload_ref
from feedloom.operators.progress import ProgressStore, advance, current_status
from feedloom.plans.registry import query, sql_stamp, stamp, table
from feedloom.session import cut_lineage, scratch_path

AS_OF = "1998-06-01 00:00:00"
EVENTS_AS_OF = "2024-01-20 00:00:00"


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tasks of orders."""
    n = F.col("l_partkey") % 10
    status = (
        F.when((F.col("l_linestatus") == "O") & (n < 4), "pending")
        .when((F.col("l_linestatus") == "O") & (n < 7), "processing")
        .when(F.col("l_returnflag") == "R", "failed")
        .when((F.col("l_returnflag") == "N") & (n == 9), "cancelled")
        .otherwise("completed")
    )
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("task_id"),
        F.col("l_orderkey").alias("job_id"),
        F.when(F.col("l_suppkey") % 3 == 0, W.EMBEDDING_TASKS).otherwise(W.FETCH_TASKS).alias("task_type"),
        status.alias("status"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity").cast("bigint")).alias("item_success"),
        F.when(F.col("l_suppkey") % 5 == 0, F.col("l_linenumber")).cast("bigint").alias("item_error"),
        F.col("l_shipdate").alias("requested_at"),
        F.when(F.col("l_suppkey") % 4 != 0, F.col("l_shipdate")).alias("claim_expires_at"),
        F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("v"), F.col("l_partkey") % 3)).alias("worker_version"),
    )


TASKS_SQL = """
    tasks AS (
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS task_id, l_orderkey AS job_id,
            CASE WHEN l_suppkey % 3 = 0 THEN 'embed.source' ELSE 'rss.fetch' END AS task_type,
            CASE WHEN l_linestatus = 'O' AND l_partkey % 10 < 4 THEN 'pending'
                WHEN l_linestatus = 'O' AND l_partkey % 10 < 7 THEN 'processing'
                WHEN l_returnflag = 'R' THEN 'failed'
                WHEN l_returnflag = 'N' AND l_partkey % 10 = 9 THEN 'cancelled' ELSE 'completed' END AS status,
            CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_quantity AS BIGINT) END AS item_success,
            CASE WHEN l_suppkey % 5 = 0 THEN l_linenumber END AS item_error,
            l_shipdate AS requested_at,
            CASE WHEN l_suppkey % 4 <> 0 THEN l_shipdate END AS claim_expires_at,
            CASE WHEN l_partkey % 3 <> 0 THEN concat('v', l_partkey % 3) END AS worker_version
        FROM lineitem
    ),
    jobs AS (
        SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'processing' ELSE 'completed' END AS status
        FROM orders
    )
"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "processing")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.otherwise("completed").alias("status"))


_PROGRESS = """
    SELECT job_id, count(*) AS task_total,
        count(*) FILTER (status = 'completed' OR status = 'failed' OR status = 'cancelled') AS task_processed,
        CAST(coalesce(sum(item_success), 0) AS BIGINT) AS item_success,
        CAST(coalesce(sum(item_error), 0) AS BIGINT) AS item_error,
        count(*) FILTER (status = 'processing') AS processing_count,
        count(*) FILTER (status = 'pending') AS pending_count,
        count(*) FILTER (status = 'cancelled') AS cancelled_count
    FROM tasks GROUP BY job_id
"""


@query("job_progress", f"WITH {TASKS_SQL} {_PROGRESS}")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_progress(tasks(spark, sf_dir))


@query(
    "job_status",
    f"""WITH {TASKS_SQL}, progress AS ({_PROGRESS})
    SELECT job_id, coalesce(task_total, 0) AS task_total, coalesce(task_processed, 0) AS task_processed,
        coalesce(item_success, 0) AS item_success, coalesce(item_error, 0) AS item_error,
        CASE WHEN task_total IS NULL THEN 'completed'
            WHEN processing_count > 0 THEN 'processing'
            WHEN pending_count > 0 AND task_processed > 0 THEN 'processing'
            WHEN pending_count > 0 THEN 'queued'
            WHEN cancelled_count > 0 THEN 'cancelled'
            WHEN item_error > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status
    FROM (SELECT job_id FROM jobs) LEFT JOIN progress USING (job_id)""",
)
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = J.job_status(jobs(spark, sf_dir), tasks(spark, sf_dir))
    return status.select("job_id", "task_total", "task_processed", "item_success", "item_error", "status")


_AFTER_TWO = "CASE part % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'processing' END"


@query(
    "job_status_batches",
    f"""WITH {TASKS_SQL}, numbered AS (
            SELECT *, CAST(string_split(task_id, '-')[3] AS BIGINT) AS part, CAST(string_split(task_id, '-')[4] AS BIGINT) AS supp FROM tasks
            QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY requested_at DESC, status DESC, item_success DESC NULLS LAST, item_error DESC NULLS LAST) = 1),
        states AS (
            SELECT 1 AS version, job_id, 'pending' AS status, 0 AS good, 0 AS bad FROM numbered
            UNION ALL SELECT 2, job_id, {_AFTER_TWO}, 0, CASE WHEN part % 3 = 1 THEN 1 ELSE 0 END FROM numbered
            UNION ALL SELECT 3, job_id + CASE WHEN supp % 10 = 0 THEN 1 ELSE 0 END, CASE WHEN supp % 2 = 0 THEN status ELSE {_AFTER_TWO} END,
                CASE WHEN supp % 2 = 0 THEN coalesce(item_success, 0) ELSE 0 END,
                CASE WHEN supp % 2 = 0 THEN coalesce(item_error, 0) WHEN part % 3 = 1 THEN 1 ELSE 0 END FROM numbered),
        known AS (SELECT DISTINCT v.version, job_id FROM states s JOIN (VALUES (1), (2), (3)) v(version) ON s.version <= v.version),
        counts AS (
            SELECT version, job_id, count(*) AS task_total, count(*) FILTER (status IN ('completed', 'failed', 'cancelled')) AS task_processed,
                sum(good) AS item_success, sum(bad) AS item_error, count(*) FILTER (status = 'processing') AS processing_count,
                count(*) FILTER (status = 'pending') AS pending_count, count(*) FILTER (status = 'cancelled') AS cancelled_count
            FROM states GROUP BY ALL)
        SELECT CAST(version AS INTEGER) AS version, job_id, coalesce(task_total, 0) AS task_total, coalesce(task_processed, 0) AS task_processed,
            CAST(coalesce(item_success, 0) AS BIGINT) AS item_success, CAST(coalesce(item_error, 0) AS BIGINT) AS item_error,
            CASE WHEN task_total IS NULL THEN 'completed'
                WHEN processing_count > 0 OR (pending_count > 0 AND task_processed > 0) THEN 'processing' WHEN pending_count > 0 THEN 'queued'
                WHEN cancelled_count > 0 THEN 'cancelled' WHEN item_error > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status
        FROM known LEFT JOIN counts USING (version, job_id)""",
)
def job_status_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of all jobs after each of three batches of task changes; the last moves tasks to other jobs."""
    store = ProgressStore.at(spark, scratch_path(spark, "progress"), parts=16)
    for version, changes in enumerate(task_batches(tasks(spark, sf_dir)), 1):
        advance(store, changes, version)
    shown = ["job_id", "task_total", "task_processed", "item_success", "item_error", "status"]
    found = [current_status(store, version=v).select(F.lit(v).alias("version"), *shown) for v in (1, 2, 3)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def task_batches(rows: DataFrame) -> list[DataFrame]:
    """All tasks as pending; two steps of some of them; the state, items and job that every second one ends with.

    Of rows that share a task id the one requested last counts. These are stored, as each batch reads them all.
    """
    latest = F.max(F.struct("requested_at", "status", "item_success", "item_error", "job_id")).alias("_row")
    rows = cut_lineage(rows.groupBy("task_id").agg(latest).select("task_id", "_row.*"))
    ids = F.split("task_id", "-")
    part, supp = ids[2].cast("bigint"), ids[3].cast("bigint")
    none = F.lit(None).cast("bigint")

    def change(seq: int, status: Column, good: Column, bad: Column, job: Column = F.col("job_id")) -> Column:
        return F.struct(F.lit(seq).alias("seq"), job.alias("job_id"), status.alias("status"), good.alias("item_success"), bad.alias("item_error"))

    steps = [
        F.array(change(1, F.lit("pending"), none, none)),
        F.when(part % 3 == 1, F.array(change(2, F.lit("processing"), none, none), change(3, F.lit("failed"), none, F.lit(1).cast("bigint"))))
        .when(part % 3 == 2, F.array(change(3, F.lit("processing"), none, none), change(2, F.lit("completed"), F.lit(9).cast("bigint"), none))),
        F.when(supp % 2 == 0, F.array(change(4, F.col("status"), F.col("item_success"), F.col("item_error"), F.col("job_id") + (supp % 10 == 0).cast("bigint")))),
    ]
    return [rows.select("task_id", F.inline(s)) for s in steps]


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as status changes of a job per user."""
    status = (
        F.when(F.col("event_type") == "signup", "queued")
        .when(F.col("event_type") == "click", "processing")
        .when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("completed_with_errors")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), status.alias("status")
    )


@query(
    "job_lifecycle",
    f"""WITH marked AS (
            SELECT user_id, event_id, ts, event_type,
                max(CASE WHEN event_type IN ('signup', 'click') THEN event_id END) OVER (PARTITION BY user_id) AS open_id,
                max(event_id) OVER (PARTITION BY user_id) AS last_id
            FROM events)
        SELECT user_id AS job_id,
            max(CASE WHEN event_id = last_id THEN CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'processing'
                WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'completed_with_errors' END END) AS status,
            {sql_stamp("arg_min(ts, event_id) FILTER (event_type <> 'signup')")} AS started_at,
            {sql_stamp("arg_min(ts, event_id) FILTER (event_id > coalesce(open_id, -1))")} AS finished_at,
            {sql_stamp("arg_min(ts, event_id) FILTER (event_id > coalesce(open_id, -1))")} AS finalized_at
        FROM marked GROUP BY user_id""",
)
def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    life = J.job_lifecycle(status_changes(spark, sf_dir))
    return life.select("job_id", "status", *[stamp(c).alias(c) for c in ("started_at", "finished_at", "finalized_at")])


def outcome_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as outcome reports of tasks."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("task_id"),
        (k % 4).alias("execution_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("outcome"),
        F.col("ts").alias("at"),
        (k - 20).alias("item_success"),
        (F.lit(10) - k).alias("item_error"),
        F.repeat(F.col("event_type"), 500).alias("error_message"),
    )


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as claimed tasks."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("task_id"),
        (key % 4).alias("execution_id"),
        F.when(key % 9 == 0, "pending").otherwise("processing").alias("status"),
        F.when(key % 3 != 0, ntz(EVENTS_AS_OF)).alias("claim_expires_at"),
        (key % 50 - 5).alias("item_total"),
    )


@query(
    "task_outcomes",
    f"""WITH reports AS (
            SELECT event_id AS seq, user_id * 10 + event_id % 10 AS task_id, event_type, ts,
                CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
        judged AS (
            SELECT *, CASE WHEN c_custkey IS NULL THEN 'unknown_task' WHEN k % 4 <> c_custkey % 4 THEN 'stale_execution'
                WHEN c_custkey % 9 = 0 THEN 'not_processing'
                WHEN c_custkey % 3 <> 0 AND ts > TIMESTAMP '{EVENTS_AS_OF}' THEN 'claim_expired' ELSE 'accepted' END AS v
            FROM reports LEFT JOIN customer ON c_custkey = task_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY task_id, v ORDER BY seq) AS nth FROM judged),
        final AS (SELECT *, CASE WHEN v = 'accepted' AND nth > 1 THEN 'not_processing' ELSE v END AS verdict FROM ranked)
        SELECT seq, task_id, k % 4 AS execution_id, verdict,
            CASE WHEN verdict = 'accepted' THEN CASE event_type WHEN 'error' THEN 'failed' ELSE 'completed' END END AS status,
            CASE WHEN verdict = 'accepted' THEN {sql_stamp('ts')} END AS completed_at,
            CASE WHEN verdict = 'accepted' THEN CASE event_type WHEN 'error' THEN 0 ELSE greatest(k - 20, 0) END END AS item_success,
            CASE WHEN verdict = 'accepted' THEN CASE event_type WHEN 'error' THEN greatest(c_custkey % 50 - 5, 0)
                ELSE greatest(10 - k, 0) END END AS item_error,
            CASE WHEN verdict = 'accepted' AND event_type = 'error' THEN substr(repeat('error', 500), 1, 2000) END AS last_error
        FROM final""",
)
def task_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = J.task_outcomes(outcome_reports(spark, sf_dir), _claims(spark, sf_dir))
    return done.withColumn("completed_at", stamp("completed_at"))


@query(
    "task_attempts",
    """SELECT event_id AS seq, user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt_count
        FROM events""",
)
def task_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("task_id"))
    return J.task_attempts(claims)


@query(
    "payload_ref",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN concat(CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE 'rss' END,
                ':', o_orderkey, ':', o_custkey) ELSE concat('rss:', o_orderkey, CASE WHEN o_orderkey % 8 = 3 THEN ':x' ELSE '' END) END AS ref,
            CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey END AS task_id, CASE WHEN o_orderkey % 4 < 3 THEN o_custkey END AS execution_id,
            o_orderkey % 4 < 3 AS valid FROM orders""",
)
def payload_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    task_type = F.when(key % 3 == 0, W.EMBEDDING_TASKS).otherwise("rss.fetch.daily")
    broken = F.concat(F.lit("rss:"), key, F.when(key % 8 == 3, ":x").otherwise(""))
    ref = F.when(key % 4 < 3, payload_ref(task_type, key, F.col("o_custkey"))).otherwise(broken)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ref.alias("ref"))
    return rows.withColumn("p", parse_payload_ref(F.col("ref"))).select("o_orderkey", "ref", "p.*")


@query(
    "ref_ids_clean",
    """SELECT c_custkey, array_to_string(list_filter([c_custkey, c_nationkey], lambda x: x > 0), ',') AS ids FROM customer""",
)
def ref_ids_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(F.col("c_custkey").cast("string"), F.lit(None), F.lit("-3"), F.lit("x"), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(clean_ref_ids(raw), ",").alias("ids"))
