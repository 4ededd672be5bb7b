"""Streaming queries over the driver tables, each run until its input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.ingest import FeedStore
from feedloom.plans import articles as A
from feedloom.plans import feeds as P
from feedloom.plans import workers as J
from feedloom.plans.registry import query, sql_stamp, stamp
from feedloom.schemas import FEED_RUNTIME
from feedloom.session import scratch_path
from feedloom.sources.partitioned import PartitionedTable
from feedloom.sources.store import KeyedTable
from feedloom.streaming import streams as S

_EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
_DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


#: Options of every source, such as ``maxFilesPerTrigger``.
OPTIONS: dict[str, str] = {}


def _source(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A driver table as a stream: a folder of part files, or one file found by its name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return S.file_stream(spark, f"{sf_dir}/{name}.parquet", schema, **OPTIONS)
    return S.file_stream(spark, sf_dir, schema, pathGlobFilter=f"{name}.parquet", **OPTIONS)


def _finish(stream: StreamingQuery) -> None:
    stream.awaitTermination()


@query("stream_feed_runtime", P.RUNTIME_SQL)
def stream_feed_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "runtime")
    table = KeyedTable(spark, f"{root}/table", ["feed_id"], FEED_RUNTIME)
    results = P.runtime_results(_source(spark, sf_dir, "events", _EVENTS))
    _finish(S.stream_feed_runtime(results, table, f"{root}/checkpoint"))
    return P.show_runtime(table.read())


@query(
    "stream_job_progress",
    """SELECT user_id AS job_id, count(*) FILTER (event_type IN ('purchase', 'error')) AS task_processed,
            CAST(sum(event_id % 5) AS BIGINT) AS item_success, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS item_error
        FROM events GROUP BY user_id""",
)
def stream_job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "progress")
    table = KeyedTable(
        spark, f"{root}/table", ["job_id"], "job_id BIGINT, task_processed BIGINT, item_success BIGINT, item_error BIGINT"
    )
    outcomes = _source(spark, sf_dir, "events", _EVENTS).select(
        F.col("user_id").alias("job_id"),
        F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("pending").alias("status"),
        (F.col("event_id") % 5).alias("item_success"),
        (F.col("event_type") == "error").cast("bigint").alias("item_error"),
    )
    _finish(S.to_table(S.running_job_progress(outcomes), table, f"{root}/checkpoint"))
    return table.read()


@query("stream_ingest", A.UPSERT_SQL)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "ingest")
    store = FeedStore.at(spark, f"{root}/store")
    store.articles.write_base(A.stored_articles(spark, sf_dir))
    candidates = A.batch_candidates(_source(spark, sf_dir, "documents", _DOCUMENTS))
    as_of = F.lit(A.AS_OF).cast("timestamp")
    _finish(S.stream_candidates(candidates, store, as_of, f"{root}/checkpoint", order="seq"))
    return A.show_articles(store.articles.read())


@query(
    "stream_dedup",
    """SELECT DISTINCT user_id * 10 + event_id % 10 AS lease_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'completed' END AS result_status,
            concat('n', event_id % 2) AS result_nonce FROM events""",
)
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "dedup")
    reports = J.reports_of(_source(spark, sf_dir, "events", _EVENTS)).withColumn("at", F.col("at").cast("timestamp"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reports.select(*S.REPORT_KEYS, "at").schema)
    seen = KeyedTable(spark, f"{root}/table", S.REPORT_KEYS, schema)
    _finish(S.stream_new_reports(reports, seen, f"{root}/checkpoint"))
    return seen.read().select("lease_id", "result_status", "result_nonce")


@query(
    "stream_rates",
    f"""SELECT {sql_stamp("date_trunc('hour', ts)")} AS window_start, {sql_stamp("date_trunc('hour', ts) + INTERVAL 1 HOUR")} AS window_end,
            count(*) AS results, count(*) FILTER (event_type = 'error') AS errors
        FROM events GROUP BY ALL""",
)
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "rates")
    results = P.runtime_results(_source(spark, sf_dir, "events", _EVENTS)).select(F.col("at").cast("timestamp").alias("at"), "status")
    table = PartitionedTable(spark, f"{root}/table", ["window_start"], S.RATES, parts=16)
    _finish(S.stream_rates(results, table, f"{root}/checkpoint"))
    return table.read().withColumns({"window_start": stamp("window_start"), "window_end": stamp("window_end")})


# What the watermark has passed at the end: an hour behind the newest result, and all results count.
_PASSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("stream_feed_silences", P.silences_sql("TIMESTAMP '9999-01-01'", _PASSED))
def stream_feed_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "silences")
    results = P.runtime_results(_source(spark, sf_dir, "events", _EVENTS)).select("feed_id", F.col("at").cast("timestamp").alias("at"), "status")
    table = KeyedTable(spark, f"{root}/table", ["feed_id", "silent_at"], S.SILENCES)
    _finish(S.stream_silences(results, table, f"{root}/checkpoint", P.SILENT_HOURS))
    return P.show_silences(table.read())
