"""Queries on the backlog, sessions, counters, usage and leases of workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import workers as W
from feedloom.plans.jobs import AS_OF, EVENTS_AS_OF, TASKS_SQL, jobs, ntz, tasks
from feedloom.plans.registry import query, sql_stamp, stamp, table

_EXPIRED = f"t.status = 'processing' AND claim_expires_at < TIMESTAMP '{AS_OF}'"
_OPEN = "j.status IN ('queued', 'processing')"


@query(
    "expired_claims",
    f"""WITH {TASKS_SQL} SELECT task_type, count(*) AS expired_claims FROM tasks t JOIN jobs j USING (job_id)
        WHERE {_EXPIRED} AND {_OPEN} GROUP BY task_type""",
)
def expired_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.expired_claims(tasks(spark, sf_dir), jobs(spark, sf_dir), ntz(AS_OF))


@query(
    "claimable_backlog",
    f"""WITH {TASKS_SQL}, ready AS (
            SELECT t.task_id, t.task_type, t.job_id, t.requested_at, row_number() OVER (PARTITION BY task_type ORDER BY requested_at, task_id) AS rank
            FROM tasks t JOIN jobs j USING (job_id)
            WHERE (t.status = 'pending' OR ({_EXPIRED})) AND {_OPEN} AND coalesce(worker_version, '') = 'v1')
        SELECT task_id, task_type, job_id, {sql_stamp('requested_at')} AS requested_at, rank FROM ready WHERE rank <= 100""",
)
def claimable_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = W.claimable_backlog(tasks(spark, sf_dir), jobs(spark, sf_dir), 100, ntz(AS_OF), worker_version="v1")
    return top.select("task_id", "task_type", "job_id", stamp("requested_at").alias("requested_at"), F.col("rank").cast("bigint").alias("rank"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as worker sessions of one day."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("session_id"),
        F.when(F.col("user_id") % 3 == 0, "embedder").otherwise("fetcher").alias("worker_type"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("expires_at"),
    )


@query(
    "active_sessions",
    f"""SELECT CASE WHEN user_id % 3 = 0 THEN 'embedder' ELSE 'fetcher' END AS worker_type, count(*) AS n
        FROM events WHERE date_trunc('day', ts) >= TIMESTAMP '{EVENTS_AS_OF}' GROUP BY 1""",
)
def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    alive = W.active_sessions(_sessions(spark, sf_dir), ntz(EVENTS_AS_OF))
    return alive.groupBy("worker_type").agg(F.count(F.lit(1)).alias("n"))


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as counter increments, some of unknown counters or not positive."""
    name = (
        F.when(F.col("event_type") == "error", W.RUNTIME_COUNTERS[0])
        .when(F.col("event_type") == "view", W.RUNTIME_COUNTERS[1])
        .otherwise(F.col("event_type"))
    )
    return table(spark, sf_dir, "events").select(
        name.alias("counter_name"), (F.get_json_object("props", "$.k").cast("bigint") - 10).alias("amount")
    )


_COUNTERS = """
    SELECT name AS counter_name, CAST(coalesce((
        SELECT sum(CAST(json_extract_string(props, '$.k') AS BIGINT) - 10) FROM events
        WHERE event_type = source AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 10), 0) AS BIGINT) AS counter_value
    FROM (VALUES ('stale_redis_task_ids_dropped', 'error'), ('embedding_tasks_requeued', 'view'), ('payload_rebuild_failures', '')) v(name, source)
"""


@query("runtime_counters", _COUNTERS)
def runtime_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.runtime_counters(_deltas(spark, sf_dir))


@query(
    "worker_stats",
    f"""WITH {TASKS_SQL}, counters AS ({_COUNTERS})
        SELECT (SELECT count(*) FROM events WHERE date_trunc('day', ts) >= TIMESTAMP '{EVENTS_AS_OF}') AS connected_workers,
            (SELECT count(*) FROM tasks WHERE status = 'pending' AND task_type = 'rss.fetch') AS pending_rss_tasks,
            (SELECT count(*) FROM tasks WHERE status = 'pending' AND task_type = 'embed.source') AS pending_embedding_tasks,
            (SELECT count(*) FROM tasks t JOIN jobs j USING (job_id) WHERE {_EXPIRED} AND {_OPEN}) AS expired_claims,
            (SELECT counter_value FROM counters WHERE counter_name LIKE 'stale%') AS stale_redis_task_ids_dropped,
            (SELECT counter_value FROM counters WHERE counter_name LIKE 'embed%') AS embedding_tasks_requeued,
            (SELECT counter_value FROM counters WHERE counter_name LIKE 'payload%') AS payload_rebuild_failures""",
)
def worker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sessions are brought to the clock of the tasks.
    expires = F.col("expires_at") - (ntz(EVENTS_AS_OF) - ntz(AS_OF))
    return W.worker_stats(
        _sessions(spark, sf_dir).withColumn("expires_at", expires), tasks(spark, sf_dir), jobs(spark, sf_dir), _deltas(spark, sf_dir), ntz(AS_OF)
    )


@query(
    "worker_usage",
    f"""SELECT user_id AS api_key_id, concat('w', event_id % 3) AS worker_name, arg_max(event_type, event_id) AS worker_type,
            arg_max(json_extract_string(props, '$.k'), event_id) AS worker_version,
            {sql_stamp('arg_max(ts, event_id)')} AS last_seen_at, count(*) AS use_count
        FROM events GROUP BY 1, 2""",
)
def worker_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("api_key_id"),
        F.concat(F.lit("w"), F.col("event_id") % 3).alias("worker_name"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("at"),
        F.col("event_type").alias("worker_type"),
        F.get_json_object("props", "$.k").alias("worker_version"),
    )
    return W.worker_usage(uses).withColumn("last_seen_at", stamp("last_seen_at"))


def reports_of(events: DataFrame) -> DataFrame:
    """User events as result reports, a lease per customer and a few distinct results each."""
    return events.select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("lease_id"),
        F.col("ts").alias("at"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("result_status"),
        F.concat(F.lit("n"), F.col("event_id") % 2).alias("result_nonce"),
        F.lit("h").alias("result_hash"),
    )


def _leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leases, expiring on the first days of the event log; the first reports name no known lease."""
    day = F.make_dt_interval((F.col("c_custkey") % 6 * 4).cast("int"))
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 100).alias("lease_id"), (ntz("2024-01-01 00:00:00") + day).alias("expires_at")
    )


@query(
    "lease_ledger",
    """WITH known AS (
            SELECT event_id AS seq, user_id * 10 + event_id % 10 AS lease_id, ts, CASE event_type WHEN 'error' THEN 'failed' ELSE 'completed' END AS s,
                concat('n', event_id % 2) AS n,
                TIMESTAMP '2024-01-01' + (c_custkey % 6 * 4) * INTERVAL 1 DAY AS expires
            FROM events LEFT JOIN customer ON c_custkey + 100 = user_id * 10 + event_id % 10),
        ranked AS (
            SELECT *, min(CASE WHEN ts < expires THEN seq END) OVER (PARTITION BY lease_id) AS hit FROM known)
        SELECT r.seq, r.lease_id, CASE WHEN r.expires IS NULL THEN 'unknown_lease' WHEN hit IS NULL OR r.seq < hit THEN 'expired'
            WHEN r.seq = hit THEN 'accepted' WHEN r.s = f.s AND r.n = f.n THEN 'replay' ELSE 'conflict' END AS verdict
        FROM ranked r LEFT JOIN known f ON f.seq = r.hit""",
)
def lease_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.lease_ledger(reports_of(table(spark, sf_dir, "events")), _leases(spark, sf_dir)).select("seq", "lease_id", "verdict")


