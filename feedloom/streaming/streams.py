"""Streaming twins of the batch operators.

A stream that keeps per-key state beyond counting does so in a keyed table: every micro-batch runs the batch operator
on its rows and the stored rows of the keys it touches. A key with very many rows is then split like in a batch job,
which a state store, holding each key in one task, could not do. Versions follow the batch number, counted on from the
version its tables had when the checkpoint was new, so a batch that is repeated after a failure writes its own version again,
and a new checkpoint on old tables goes on behind their history.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.feeds import ERROR
from feedloom.operators.ingest import FeedStore, Table, ingest_candidates, ingest_envelopes, update_runtime
from feedloom.operators.jobs import PROCESSED
from feedloom.operators.language import Detector
from feedloom.operators.progress import ProgressStore, advance
from feedloom.operators.skew import CHUNK_ROWS
from feedloom.session import cut_lineage, scratch
from feedloom.sources.store import KeyedTable


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", **options: str) -> DataFrame:
    """Rows of the files that appear at ``path``."""
    return spark.readStream.schema(schema).options(**options).format(kind).load(path)


def _start_version(spark: SparkSession, checkpoint: str, tables: Sequence[Table]) -> int:
    """The newest version of ``tables`` when this checkpoint was first used, kept in its folder."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/{name}")
    fs = path("x").getFileSystem(context._jsc.hadoopConfiguration())
    if not fs.exists(path("start_version")):
        # A checkpoint with batches but without this file began at 0.
        start = 0 if fs.exists(path("commits")) else max(table.newest() for table in tables)
        draft = path(f".start-{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.writeBytes(str(start))
        stream.close()
        fs.rename(draft, path("start_version"))
    stream = fs.open(path("start_version"))
    try:
        return int(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _each_batch(
    rows: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str, tables: Sequence[Table]
) -> StreamingQuery:
    """Run ``work(batch, version)`` for what is available now; versions follow those that ``tables`` had at the start."""
    start = _start_version(rows.sparkSession, checkpoint, tables)
    return (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: work(batch, start + batch_id + 1))
        .trigger(availableNow=True)
        .start()
    )


def stream_candidates(
    candidates: DataFrame, store: FeedStore, as_of: Column, checkpoint: str,
    chunk_rows: int = CHUNK_ROWS, order: str = "event_seq",
) -> StreamingQuery:
    """Merge a stream of candidate rows into the store."""
    work = lambda batch, version: ingest_candidates(batch, store, version, as_of, chunk_rows, order)
    return _each_batch(candidates, work, checkpoint, "append", store.tables())


def stream_ingest(
    raw: DataFrame, contexts: DataFrame, store: FeedStore, quarantine: str, as_of: Column, checkpoint: str,
    detector: Detector | None = None,
) -> StreamingQuery:
    """Result envelopes (``envelope_id, body``) to the store; rejected envelopes to ``quarantine``."""

    def work(batch: DataFrame, version: int) -> None:
        ingest_envelopes(batch, contexts, store, quarantine, version, as_of, detector)

    return _each_batch(raw, work, checkpoint, "append", store.tables())


def stream_feed_runtime(
    results: DataFrame, runtime: KeyedTable, checkpoint: str, chunk_rows: int = CHUNK_ROWS
) -> StreamingQuery:
    """Keep feed health up to date from a stream of results."""
    work = lambda batch, version: update_runtime(batch, runtime, version, chunk_rows)
    return _each_batch(results, work, checkpoint, "append", [runtime])


#: What makes two result reports of a lease the same report.
REPORT_KEYS = ["lease_id", "result_status", "result_nonce", "result_hash"]


def stream_new_reports(reports: DataFrame, seen: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Add each report to ``seen`` (keyed on :data:`REPORT_KEYS`) once, however late it comes again.

    A report that differs from earlier ones of its lease is kept for the ledger. Copies within a micro-batch are reduced
    before they are compared with the table, so the answer does not depend on how rows fall into micro-batches.
    """

    def work(batch: DataFrame, version: int) -> None:
        known = seen.read(version - 1).select(*[F.col(k).alias(f"_{k}") for k in REPORT_KEYS])
        first = batch.groupBy(*REPORT_KEYS).agg(F.min("at").alias("at"))
        same = reduce(Column.__and__, [first[k].eqNullSafe(known[f"_{k}"]) for k in REPORT_KEYS])
        seen.write(first.join(known, same, "left_anti"), version)

    return _each_batch(reports, work, checkpoint, "append", [seen])


def running_job_progress(outcomes: DataFrame) -> DataFrame:
    """Task and item counts per job over a stream of finished tasks (``job_id, status, item_success, item_error``)."""
    return outcomes.groupBy("job_id").agg(
        F.count_if(F.col("status").isin(PROCESSED)).alias("task_processed"),
        F.coalesce(F.sum("item_success"), F.lit(0)).alias("item_success"),
        F.coalesce(F.sum("item_error"), F.lit(0)).alias("item_error"),
    )


def result_rates(results: DataFrame, width: str = "1 hour", delay: str | None = "1 hour") -> DataFrame:
    """Results and errors per feed status in each time window of ``at``.

    Without ``delay`` no row is too late, and the state of all windows is kept: for tables that are read to their end.
    """
    timed = results if delay is None else results.withWatermark("at", delay)
    windowed = timed.groupBy(F.window("at", width).alias("w"))
    return windowed.agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("status") == "error").alias("errors")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "results", "errors"
    )


RATES = "window_start TIMESTAMP, window_end TIMESTAMP, results BIGINT, errors BIGINT"


def stream_rates(results: DataFrame, rates: Table, checkpoint: str, width: str = "1 hour") -> StreamingQuery:
    """The counts of :func:`result_rates` in ``rates`` (keyed on ``window_start``, columns of ``RATES``), however late rows come.

    No window is held as state: the counts of a batch are added to the stored rows of its windows alone, so memory follows the
    windows of a batch, and a window that was thought finished still gets its late rows.
    """

    def work(batch: DataFrame, version: int) -> None:
        with scratch(batch.sparkSession) as root:
            counts = cut_lineage(result_rates(batch, width, None), root)
            known = rates.lookup(counts, version - 1)
            both = counts.unionByName(known).groupBy("window_start", "window_end")
            rates.write(both.agg(F.sum("results").alias("results"), F.sum("errors").alias("errors")), version)

    return _each_batch(results, work, checkpoint, "append", [rates])


SILENCES = (
    "feed_id BIGINT, active_from TIMESTAMP, last_result_at TIMESTAMP, silent_at TIMESTAMP, results BIGINT, errors BIGINT"
)


def running_silences(results: DataFrame, hours: int, delay: str) -> DataFrame:
    """Silences of feeds, as :func:`feedloom.operators.feeds.feed_silences` defines them, from a stream of results.

    A feed's results are one session until none has come for ``hours``; its end is the silence. It is told when the watermark,
    ``delay`` behind the newest result of all feeds, has passed it, so a feed need not report again to be found silent. The
    state holds the open sessions alone: some per feed, however many results they have. Results behind the watermark are left out.
    """
    gap = F.make_dt_interval(hours=F.lit(hours))
    session = F.session_window("at", f"{hours} hours").alias("s")
    sessions = results.withWatermark("at", delay).groupBy("feed_id", session).agg(
        F.count(F.lit(1)).alias("results"), F.count_if(F.col("status") == ERROR).alias("errors")
    )
    end = F.col("s.end")
    return sessions.select(
        "feed_id", F.col("s.start").alias("active_from"), (end - gap).alias("last_result_at"), end.alias("silent_at"), "results", "errors"
    )


def stream_silences(
    results: DataFrame, silences: Table, checkpoint: str, hours: int = 24, delay: str = "1 hour"
) -> StreamingQuery:
    """Add the silences of a stream of results to ``silences`` (keyed on ``feed_id`` and ``silent_at``, columns of ``SILENCES``)."""
    work = lambda batch, version: silences.write(batch, version)
    return _each_batch(running_silences(results, hours, delay), work, checkpoint, "append", [silences])


def stream_progress(changes: DataFrame, store: ProgressStore, checkpoint: str) -> StreamingQuery:
    """Keep job progress up to date from a stream of task changes (columns of ``TASK_STATE`` and ``seq``)."""
    work = lambda batch, version: advance(store, batch, version)
    return _each_batch(changes, work, checkpoint, "append", [store.tasks])


def to_files(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to Parquet files."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(rows: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Store the rows that changed in each batch of an updating aggregate."""
    return _each_batch(rows, lambda batch, version: table.write(batch, version), checkpoint, "update", [table])
