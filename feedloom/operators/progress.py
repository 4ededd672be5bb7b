"""Job progress kept up to date by batches of task changes: what a task counted for is taken back, what it counts for is added."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.jobs import COUNTS, PROCESSED, status_of_counts
from feedloom.session import cut_lineage, scratch
from feedloom.sources.partitioned import PARTS, PartitionedTable

TASK_STATE = "task_id STRING, job_id BIGINT, status STRING, item_success BIGINT, item_error BIGINT"
JOB_COUNTS = "job_id BIGINT, " + ", ".join(f"{name} BIGINT" for name in COUNTS)


@dataclass(frozen=True)
class ProgressStore:
    """The last known state of every task and the counts of every job; a batch writes both under its version."""

    tasks: PartitionedTable
    jobs: PartitionedTable

    @classmethod
    def at(cls, spark: SparkSession, root: str, parts: int = PARTS) -> ProgressStore:
        return cls(
            PartitionedTable(spark, f"{root}/tasks", ["task_id"], TASK_STATE, parts, indexed=True),
            PartitionedTable(spark, f"{root}/jobs", ["job_id"], JOB_COUNTS, parts),
        )


def _counted(sign: int) -> list[Column]:
    status, one = F.col("status"), F.lit(sign).cast("bigint")
    when = lambda holds: F.when(holds, one).otherwise(F.lit(0))
    items = lambda c: F.coalesce(F.col(c), F.lit(0)) * sign
    values = [
        one, when(status.isin(PROCESSED)), items("item_success"), items("item_error"),
        when(status == "processing"), when(status == "pending"), when(status == "cancelled"),
    ]
    return [F.col("job_id"), *[v.cast("bigint").alias(name) for v, name in zip(values, COUNTS, strict=True)]]


def count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What the counts of each job gain or lose when tasks (unique on ``task_id``) go from ``before`` to ``after``.

    A plain sum per job, combined in the tasks, so a job with a third of all tasks is no hot key. A task that changes its
    job leaves one and enters the other.
    """
    moved = before.select(*_counted(-1)).unionByName(after.select(*_counted(1)))
    return moved.groupBy("job_id").agg(*[F.sum(name).alias(name) for name in COUNTS])


def advance(store: ProgressStore, changes: DataFrame, version: int) -> None:
    """Fold task changes (columns of ``TASK_STATE`` and ``seq``) into the store as ``version``.

    The last change of a task in the batch counts. Only the batch's tasks and their jobs are read, as of the version before,
    so a batch that is delivered again, also after a loss between the two writes, changes nothing.
    """
    names = store.tasks._struct().names
    with scratch(changes.sparkSession) as root:
        last = changes.groupBy("task_id").agg(F.max_by(F.struct(*names), "seq").alias("_row")).select("_row.*")
        after = cut_lineage(last, root)
        before = store.tasks.lookup(after, version - 1)
        moved = cut_lineage(count_changes(before, after), root)
        known = store.jobs.lookup(moved, version - 1)
        counts = moved.unionByName(known).groupBy("job_id").agg(*[F.sum(name).alias(name) for name in COUNTS])
        store.jobs.write(counts, version)
        store.tasks.write(after, version)


def current_status(store: ProgressStore, jobs: DataFrame | None = None, version: int | None = None) -> DataFrame:
    """Counts and status of jobs, of all known ones or, with zeros for those without tasks, of ``jobs`` (``job_id``)."""
    if jobs is None:
        counts = store.jobs.read(version)
    else:
        counts = jobs.select("job_id").join(store.jobs.lookup(jobs, version), "job_id", "left").na.fill(0, COUNTS)
    return counts.withColumn("status", status_of_counts())
