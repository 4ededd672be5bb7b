"""Backlog, sessions, counters, usage and lease results of the workers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.jobs import OPEN_JOB
from feedloom.operators.skew import hot_keys, measured_join, salted_join

# Task types and runtime counters known to the statistics.
FETCH_TASKS = "rss.fetch"
EMBEDDING_TASKS = "embed.source"
RUNTIME_COUNTERS = ["stale_redis_task_ids_dropped", "embedding_tasks_requeued", "payload_rebuild_failures"]


def active_sessions(sessions: DataFrame, as_of: Column, worker_type: str | None = None) -> DataFrame:
    """Sessions that have not expired; a session expiring right now still counts."""
    alive = sessions.where(F.col("expires_at") >= as_of)
    return alive if worker_type is None else alive.where(F.col("worker_type") == worker_type)


def _expired(as_of: Column) -> Column:
    return (F.col("status") == "processing") & (F.col("claim_expires_at") < as_of)


def _open_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(OPEN_JOB)).select("job_id")


def expired_claims(tasks: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Number of overdue claims of open jobs per task type, counted per job before the join."""
    per_job = tasks.where(_expired(as_of)).groupBy("job_id", "task_type").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_job.join(_open_jobs(jobs), "job_id", "left_semi").groupBy("task_type").agg(F.sum("n").alias("expired_claims"))
    )


def claimable_backlog(
    tasks: DataFrame, jobs: DataFrame, k: int, as_of: Column, worker_version: str | None = None
) -> DataFrame:
    """The first ``k`` claimable tasks of each type by request time, with their rank.

    The rank limit is applied inside each partition before the exchange, so a type never gathers
    more than ``k`` rows per task in one place.
    """
    ready = tasks.where((F.col("status") == "pending") | _expired(as_of))
    if worker_version is not None:
        ready = ready.where(F.coalesce("worker_version", F.lit("")) == worker_version)
    job = _open_jobs(jobs).withColumn("_open", F.lit(True))
    open_tasks = measured_join(ready, job, "job_id", spread=["task_id"], how="inner").drop("_open")
    queue = Window.partitionBy("task_type").orderBy("requested_at", "task_id")
    return open_tasks.withColumn("rank", F.row_number().over(queue)).where(F.col("rank") <= max(1, k))


def runtime_counters(deltas: DataFrame) -> DataFrame:
    """Sum of the positive deltas of each known counter; a counter without any is zero."""
    useful = deltas.where(F.col("counter_name").isin(RUNTIME_COUNTERS) & (F.col("amount") > 0))
    zero = deltas.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(n) for n in RUNTIME_COUNTERS])).alias("counter_name"), F.lit(0).alias("amount")
    )
    amounts = useful.select("counter_name", F.col("amount").cast("bigint").alias("amount")).unionByName(zero)
    return amounts.groupBy("counter_name").agg(F.sum("amount").alias("counter_value"))


def worker_stats(
    sessions: DataFrame, tasks: DataFrame, jobs: DataFrame, deltas: DataFrame, as_of: Column
) -> DataFrame:
    """One row of service figures; tasks are read once and counted per job before they meet the jobs."""
    pending = F.col("status") == "pending"
    per_job = tasks.where(pending | _expired(as_of)).groupBy("job_id").agg(
        F.count_if(pending & (F.col("task_type") == FETCH_TASKS)).alias("rss"),
        F.count_if(pending & (F.col("task_type") == EMBEDDING_TASKS)).alias("embedding"),
        F.count_if(_expired(as_of)).alias("expired"),
    )
    open_job = _open_jobs(jobs).withColumn("_open", F.lit(True))
    figures = [
        _named(active_sessions(sessions, as_of).agg(F.count(F.lit(1)).alias("n")), "connected_workers", "n"),
        per_job.join(open_job, "job_id", "left")
        .agg(
            F.sum("rss").alias("pending_rss_tasks"),
            F.sum("embedding").alias("pending_embedding_tasks"),
            F.sum(F.when(F.col("_open"), F.col("expired"))).alias("expired_claims"),
        )
        .unpivot([], ["pending_rss_tasks", "pending_embedding_tasks", "expired_claims"], "name", "value"),
        runtime_counters(deltas).toDF("name", "value"),
    ]
    names = ["connected_workers", "pending_rss_tasks", "pending_embedding_tasks", "expired_claims", *RUNTIME_COUNTERS]
    value = lambda n: F.sum(F.when(F.col("name") == n, F.col("value")))
    return reduce(DataFrame.unionByName, figures).agg(
        *[F.coalesce(value(n), F.lit(0)).cast("bigint").alias(n) for n in names]
    )


def _named(counted: DataFrame, name: str, value: str) -> DataFrame:
    return counted.select(F.lit(name).alias("name"), F.col(value).alias("value"))


def worker_usage(uses: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Per API key and worker: number of uses, and type, version and time of the last one."""
    last = F.max(F.struct("seq", "at", "worker_type", "worker_version"))
    new = uses.groupBy("api_key_id", "worker_name").agg(last.alias("_l"), F.count(F.lit(1)).alias("use_count"))
    new = new.select(
        "api_key_id",
        "worker_name",
        F.col("_l.worker_type").alias("worker_type"),
        F.col("_l.worker_version").alias("worker_version"),
        F.col("_l.at").alias("last_seen_at"),
        "use_count",
    )
    if previous is None:
        return new
    tagged = previous.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    newest = F.max(F.struct("_age", "worker_type", "worker_version", "last_seen_at"))
    return tagged.groupBy("api_key_id", "worker_name").agg(newest.alias("_l"), F.sum("use_count").alias("use_count")).select(
        "api_key_id", "worker_name", "_l.worker_type", "_l.worker_version", "_l.last_seen_at", "use_count"
    )


def lease_ledger(results: DataFrame, leases: DataFrame) -> DataFrame:
    """Verdict on every result report of a lease.

    ``results``: ``seq, lease_id, at, result_status, result_nonce, result_hash``. ``leases``: ``lease_id, expires_at``. The
    first report before the expiry is accepted. After it, the same report again is a replay and another one a
    conflict, expired or not. Without an accepted report a late one is just expired.
    """
    hot = hot_keys(results, "lease_id")
    triple = F.struct("result_status", "result_nonce", "result_hash")
    known = salted_join(results, leases.select("lease_id", "expires_at"), "lease_id", spread=["seq"], hot=hot)
    in_time = known.where(F.col("at") < F.col("expires_at"))
    first = in_time.groupBy("lease_id").agg(F.min(F.struct(F.col("seq"), triple.alias("triple"))).alias("_first"))
    ledger = salted_join(known, first, "lease_id", spread=["seq"], hot=hot)
    verdict = (
        F.when(F.col("expires_at").isNull(), "unknown_lease")
        .when(F.col("_first").isNull() | (F.col("seq") < F.col("_first.seq")), "expired")
        .when(F.col("seq") == F.col("_first.seq"), "accepted")
        .when(triple.eqNullSafe(F.col("_first.triple")), "replay")
        .otherwise("conflict")
    )
    return ledger.withColumn("verdict", verdict).drop("_first")
