"""Job progress, status and lifecycle; task outcomes and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.skew import CHUNK_ROWS, chunk_of, earlier, salted_join, since_reset

# Task statuses and the job statuses that set lifecycle times.
PROCESSED = ["completed", "failed", "cancelled"]
OPEN_JOB = ["queued", "processing"]
TERMINAL = ["cancelled", "completed", "completed_with_errors", "failed"]
STARTED = ["processing", "paused", *TERMINAL]
MAX_ERROR_TEXT = 2000

COUNTS = [
    "task_total", "task_processed", "item_success", "item_error",
    "processing_count", "pending_count", "cancelled_count",
]


def job_progress(tasks: DataFrame) -> DataFrame:
    """Task and item counts per job in one aggregation."""
    status = F.col("status")
    return tasks.groupBy("job_id").agg(
        F.count("task_id").alias("task_total"),
        F.count_if(status.isin(PROCESSED)).alias("task_processed"),
        F.coalesce(F.sum("item_success"), F.lit(0)).cast("bigint").alias("item_success"),
        F.coalesce(F.sum("item_error"), F.lit(0)).cast("bigint").alias("item_error"),
        F.count_if(status == "processing").alias("processing_count"),
        F.count_if(status == "pending").alias("pending_count"),
        F.count_if(status == "cancelled").alias("cancelled_count"),
    )


def status_of_counts() -> Column:
    """Job status from the counts of :func:`job_progress`; the first rule that holds decides."""
    c = F.col
    return (
        F.when(c("task_total") == 0, "completed")
        .when((c("processing_count") > 0) | ((c("task_processed") > 0) & (c("pending_count") > 0)), "processing")
        .when(c("pending_count") > 0, "queued")
        .when(c("cancelled_count") > 0, "cancelled")
        .when(c("item_error") > 0, "completed_with_errors")
        .otherwise("completed")
    )


def job_status(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Counts and status of every job, also of jobs without tasks."""
    counts = jobs.select("job_id").join(job_progress(tasks), "job_id", "left").na.fill(0, COUNTS)
    return counts.withColumn("status", status_of_counts())


def job_lifecycle(changes: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Start and finish times from status changes ``job_id, seq, at, status``.

    The start is the first change to a started status and stays. The finish is the first of the terminal
    changes that end the history; any later non-terminal change takes it back.
    """
    terminal = F.col("status").isin(TERMINAL)
    folded = since_reset(
        changes,
        "job_id",
        "seq",
        chunk_of("seq", chunk_rows),
        reset=~terminal,
        tail={"finish": (F.min, F.struct("seq", "at"), F.min)},
        whole={
            "start": (F.min(F.when(F.col("status").isin(STARTED), F.struct("seq", "at"))), F.min),
            "state": (F.max(F.struct("seq", "status")), F.max),
        },
    )
    return folded.select(
        "job_id",
        F.col("state.status").alias("status"),
        F.col("start.at").alias("started_at"),
        F.col("finish.at").alias("finished_at"),
        F.col("finish.at").alias("finalized_at"),
    )


def result_counts(events: Column) -> Column:
    """``(item_success, item_error)`` of an array of result events; anything but an error is a success."""
    errors = F.size(F.filter(events, lambda e: e["status"] == "error"))
    return F.struct(
        (F.size(events) - errors).cast("bigint").alias("item_success"), errors.cast("bigint").alias("item_error")
    )


def task_outcomes(outcomes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Judge every outcome report and derive the task fields an accepted one sets.

    ``outcomes``: ``seq, task_id, execution_id, outcome, at, item_success, item_error, error_message``. ``tasks``: the
    claim each report must match, ``task_id, execution_id, status, claim_expires_at, item_total``. Only the first
    acceptable report of a task counts, since it ends the claim.

    Error texts may be long, so only those a failure may show travel, cut to the length they are shown at, and rows with
    them pass by the narrow claims and winners instead of being sorted.
    """
    shown = F.when(F.col("outcome") == "failed", F.substring("error_message", 1, MAX_ERROR_TEXT))
    claim = tasks.select(
        "task_id",
        F.col("execution_id").alias("_execution"),
        F.col("status").alias("_status"),
        "claim_expires_at",
        "item_total",
    )
    joined = salted_join(outcomes.withColumn("error_message", shown), claim, "task_id", spread=["seq"], hint="shuffle_hash")
    verdict = (
        F.when(F.col("_status").isNull(), "unknown_task")
        .when(~F.col("execution_id").eqNullSafe(F.col("_execution")), "stale_execution")
        .when(F.col("_status") != "processing", "not_processing")
        .when(F.coalesce(F.col("claim_expires_at") < F.col("at"), F.lit(False)), "claim_expired")
        .otherwise("accepted")
    )
    judged = joined.withColumn("verdict", verdict)
    judged = judged.withColumn("error_message", F.when(F.col("verdict") == "accepted", F.col("error_message")))
    winners = (
        judged.where(F.col("verdict") == "accepted")
        .groupBy("task_id")
        .agg(F.min("seq").alias("seq"))
        .select("seq", F.lit(True).alias("_won"))
    )
    late = (F.col("verdict") == "accepted") & F.col("_won").isNull()
    done = judged.join(winners.hint("shuffle_hash"), "seq", "left").withColumn(
        "verdict", F.when(late, "not_processing").otherwise(F.col("verdict"))
    )
    accepted = F.col("verdict") == "accepted"
    completed = accepted & (F.col("outcome") == "completed")
    failed = accepted & (F.col("outcome") == "failed")
    at_least_zero = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0))).cast("bigint")
    return done.select(
        "seq",
        "task_id",
        "execution_id",
        "verdict",
        F.when(accepted, F.col("outcome")).alias("status"),
        F.when(accepted, F.col("at")).alias("completed_at"),
        F.when(completed, at_least_zero("item_success")).when(failed, F.lit(0)).alias("item_success"),
        F.when(completed, at_least_zero("item_error")).when(failed, at_least_zero("item_total")).alias("item_error"),
        F.when(failed, F.col("error_message")).alias("last_error"),
    )


def task_attempts(claims: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``attempt_count`` to claim events ``task_id, seq``: one more with every claim of the task."""
    counted = earlier(
        claims,
        "task_id",
        "seq",
        chunk_of("seq", chunk_rows),
        F.lit(1).cast("bigint"),
        F.sum,
        lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "_before",
    )
    return counted.withColumn("attempt_count", F.col("_before") + 1).drop("_before")
