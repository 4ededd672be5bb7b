"""Query on gated ingest: documents as the events of delivered envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import gate as G
from feedloom.plans.registry import query, table
from feedloom.session import cut_lineage
from feedloom.sources.results import parse_results

_AT = "TIMESTAMP '2024-01-01'"
_SQL = f"""WITH docs AS (
        SELECT doc_id, doc_id // 4 AS envelope_id, doc_id // 8 AS lease_id, doc_id % 4 AS pos, doc_id % 9 + 1 AS feed FROM documents),
    -- What an envelope breaks by itself, and what the task of its lease asked for beyond it.
    env AS (
        SELECT envelope_id, any_value(lease_id) AS lease_id, count(*) AS n, envelope_id % 13 = 5 AS invalid,
            any_value(lease_id) % 5 = 1 OR any_value(lease_id) % 7 = 2 OR envelope_id % 11 = 3 AND count(*) > 1 OR envelope_id % 2 = 1 AS incomplete,
            CASE WHEN any_value(lease_id) % 6 = 4 THEN envelope_id % 2 = 0 ELSE true END AS in_time,
            CASE WHEN any_value(lease_id) % 3 = 0 THEN 0 ELSE envelope_id % 2 END AS nonce
        FROM docs GROUP BY envelope_id),
    first AS (SELECT lease_id, min(envelope_id) FILTER (in_time) AS winner FROM env GROUP BY lease_id),
    judged AS (
        SELECT e.*, CASE
            WHEN e.lease_id % 17 = 16 THEN 'unknown_lease'
            WHEN winner IS NULL OR e.envelope_id < winner THEN 'expired'
            WHEN e.envelope_id > winner THEN CASE WHEN e.nonce = (SELECT nonce FROM env w WHERE w.envelope_id = winner) THEN 'replay' ELSE 'conflict' END
            WHEN invalid THEN 'invalid' WHEN incomplete THEN 'incomplete' ELSE 'stored' END AS verdict
        FROM env e JOIN first USING (lease_id))
    SELECT envelope_id, lease_id, verdict,
        CAST(CASE WHEN verdict = 'stored' THEN (SELECT count(*) FROM docs d WHERE d.envelope_id = j.envelope_id AND doc_id % 3 <> 0) ELSE 0 END AS BIGINT) AS item_success,
        CAST(CASE WHEN verdict = 'stored' THEN (SELECT count(*) FROM docs d WHERE d.envelope_id = j.envelope_id AND doc_id % 3 = 0) ELSE 0 END AS BIGINT) AS item_error
    FROM judged j"""


def deliveries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Envelopes of four documents as JSON, two for each lease, with their reports, the leases and the tasks.

    Some break the contract, repeat a feed, miss one, name another job, come late, come again, or have no lease.
    """
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.floor(n / 4).cast("long").alias("envelope_id"), F.floor(n / 8).cast("long").alias("lease_id"), (n % 4).alias("pos"),
    )
    repeats = (F.col("envelope_id") % 11 == 3) & (F.col("pos") == 1)
    feed = F.when(repeats, (n - 1) % 9 + 1).otherwise(n % 9 + 1)
    source = F.struct(F.concat(F.lit("Title "), n).alias("title"), F.array(F.concat(F.lit("https://a.example/"), n)).alias("urls"))
    event = F.struct(
        "pos", feed.alias("feed_id"),
        F.concat(F.when((F.col("lease_id") % 7 == 2) & (F.col("pos") == 0), "other").otherwise("job"), F.col("lease_id")).alias("job_id"),
        F.when(F.col("envelope_id") % 13 == 5, "done").when(n % 3 == 0, "error").otherwise("success").alias("status"),
        F.array(source).alias("sources"),
    )
    sets = docs.groupBy("envelope_id", "lease_id").agg(F.sort_array(F.collect_list(event)).alias("events"))  # four rows at most
    said = F.transform("events", lambda e: e.dropFields("pos"))
    raw = sets.select("envelope_id", F.to_json(F.struct(F.lit("1").alias("contract_version"), said.alias("result_events"))).alias("body"))
    e, lease = F.col("envelope_id"), F.col("lease_id")
    reports = sets.select(
        "envelope_id", "lease_id", F.expr(f"{_AT} + make_interval(0, 0, 0, 0, 0, cast(envelope_id % 2 as int), 0)").cast("timestamp").alias("at"),
        F.lit("completed").alias("result_status"), F.concat(F.lit("n"), F.when(lease % 3 == 0, 0).otherwise(e % 2)).alias("result_nonce"),
        F.lit("h").alias("result_hash"),
    )
    # A lease asks for the feeds of its even envelope, sometimes for one more, and may end between the two reports.
    asked = docs.where("envelope_id % 2 = 0").groupBy("lease_id").agg(F.collect_list(n % 9 + 1).alias("ids"))
    more = F.when(lease % 5 == 1, F.array(F.lit(100).cast("long"))).otherwise(F.array().cast("array<long>"))
    tasks = asked.select(lease.alias("task_id"), F.concat(F.lit("job"), lease).alias("job_id"), F.concat("ids", more).alias("ref_ids"))
    ends = F.expr(f"{_AT} + INTERVAL 1 MINUTE").cast("timestamp")
    leases = docs.where("lease_id % 17 <> 16").select("lease_id").distinct().select(
        "lease_id", lease.alias("task_id"), F.when(lease % 6 == 4, ends).otherwise(F.expr(f"{_AT} + INTERVAL 1 DAY").cast("timestamp")).alias("expires_at")
    )
    return raw, reports, leases, tasks


@query("ingest_gated", _SQL)
def ingest_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, reports, leases, tasks = deliveries(spark, sf_dir)
    verdicts, _ = G.gate(reports, leases, tasks, cut_lineage(parse_results(raw)), spark.createDataFrame([], G.TAKEN))
    return verdicts.select("envelope_id", "lease_id", "verdict", "item_success", "item_error")
