"""The gate between delivered envelopes and the store.

An envelope is stored if it is readable and keeps the contract, its lease gave it the right to report, and its events
answer the whole task: every requested feed once, no other, all of the task's job. One broken rule keeps the whole set out.
The first report of a lease takes the lease, whether its set is stored or not; the same report again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.ingest import FeedStore, Table, ingest_events, number_events
from feedloom.operators.jobs import result_counts
from feedloom.operators.language import Detector
from feedloom.operators.quality import completeness_violations, split_valid
from feedloom.operators.skew import salted_join
from feedloom.operators.workers import lease_ledger
from feedloom.session import cut_lineage
from feedloom.sources.results import parse_results, result_events

#: Columns of a report that make it the same report when it is delivered again.
REPORT = ["result_status", "result_nonce", "result_hash"]
#: Schema of the table of leases that are taken, keyed by lease.
TAKEN = "lease_id BIGINT, result_status STRING, result_nonce STRING, result_hash STRING, at TIMESTAMP, expires_at TIMESTAMP"


def reserve(reports: DataFrame, leases: DataFrame, taken: DataFrame) -> DataFrame:
    """``reports`` with ``expires_at`` and the verdict of their lease; ``taken`` are reports that took leases before."""
    before = taken.select(F.lit(-1).cast("long").alias("seq"), "lease_id", "at", *REPORT)
    rows = reports.select(F.col("envelope_id").alias("seq"), "lease_id", "at", *REPORT).unionByName(before)
    ledger = lease_ledger(rows, leases).where("seq >= 0")
    return ledger.withColumnRenamed("seq", "envelope_id")


def gate(reports: DataFrame, leases: DataFrame, tasks: DataFrame, envelopes: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One verdict per report, and the valid envelopes of those that are to be stored.

    ``reports``: ``envelope_id, lease_id, at`` and :data:`REPORT`, ``envelope_id`` giving the order. ``leases``: ``lease_id,
    task_id, expires_at``. ``tasks``: ``task_id, job_id, ref_ids``. ``envelopes`` as read by :func:`parse_results`. Verdicts:
    ``stored``, ``invalid``, ``incomplete``, and those of :func:`lease_ledger` but ``accepted``. ``item_success`` and
    ``item_error`` count the stored events, and are 0 otherwise. An empty table of reports gives no rows.
    """
    held = reserve(reports, leases, taken)
    good, _ = split_valid(envelopes)
    good = cut_lineage(good)
    accepted = cut_lineage(held.where("verdict = 'accepted'").select("envelope_id", "lease_id"))
    mine = accepted.join(leases.select("lease_id", "task_id"), "lease_id", "left")
    valid = good.join(mine.select("envelope_id", "task_id"), "envelope_id")
    events = result_events(valid.select("envelope_id", "result_events")).select("envelope_id", "feed_id", "job_id")
    # Each accepted report is held against its own copy of the task.
    asked = valid.select(F.col("envelope_id").alias("report"), "task_id")
    own = salted_join(asked, tasks, "task_id", spread=["report"]).select(F.col("report").alias("task_id"), "job_id", "ref_ids")
    broken = completeness_violations(own, events.withColumnRenamed("envelope_id", "task_id")).select(F.col("task_id").alias("envelope_id")).distinct()
    whole = cut_lineage(valid.join(broken, "envelope_id", "left_anti"))
    counts = whole.select("envelope_id", result_counts(F.col("result_events")).alias("n"))
    marks = valid.select("envelope_id", F.lit(True).alias("_valid")).join(counts, "envelope_id", "left")
    judged = held.join(marks, "envelope_id", "left")
    verdict = (
        F.when(F.col("verdict") != "accepted", F.col("verdict"))
        .when(F.col("_valid").isNull(), "invalid")
        .when(F.col("n").isNull(), "incomplete")
        .otherwise("stored")
    )
    zero = F.lit(0).cast("long")
    verdicts = judged.select(
        "envelope_id", "lease_id", "at", *REPORT, "expires_at", (F.col("verdict") == "accepted").alias("takes_lease"), verdict.alias("verdict"),
        F.coalesce("n.item_success", zero).alias("item_success"), F.coalesce("n.item_error", zero).alias("item_error"),
    )
    return verdicts, whole.drop("task_id")


def ingest_gated(
    raw: DataFrame, reports: DataFrame, leases: DataFrame, tasks: DataFrame, contexts: DataFrame,
    store: FeedStore, taken: Table, version: int, as_of: Column, detector: Detector | None = None,
) -> DataFrame:
    """Judge a batch of delivered envelopes (``envelope_id, body``), store the good sets as ``version``, return all verdicts.

    ``taken``, keyed by ``lease_id`` with the columns of :data:`TAKEN`, is written last: until then a repeated batch runs
    anew and writes the same rows, afterwards its reports are replays.
    """
    verdicts, whole = gate(reports, leases, tasks, parse_results(raw), taken.read(version - 1))
    verdicts = cut_lineage(verdicts)
    ingest_events(number_events(whole), contexts, store, version, as_of, detector)
    taken.write(verdicts.where("takes_lease").select("lease_id", *REPORT, "at", "expires_at"), version)
    return verdicts
