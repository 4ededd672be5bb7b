"""Queries on partitioned keyed tables: batches of changes, compaction and lookups by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import merge
from feedloom.operators.candidates import flag_duplicates_in
from feedloom.plans import articles as A
from feedloom.plans.registry import ORACLES, query, table
from feedloom.session import scratch_path
from feedloom.sources.partitioned import PartitionedTable

_SCHEMA = "custkey BIGINT, batch INT, last_order BIGINT, spent DOUBLE"
_SQL = """WITH changes AS (
        SELECT o_custkey AS custkey, 2 + o_orderkey % 2 AS batch, max(o_orderkey) AS last_order, max(o_totalprice) AS spent FROM orders GROUP BY ALL),
    rows AS (SELECT c_custkey AS custkey, 1 AS batch, NULL::BIGINT AS last_order, c_acctbal AS spent FROM customer UNION ALL SELECT * FROM changes)
    SELECT custkey, CAST(max(batch) AS INTEGER) AS batch, CAST(arg_max_null(last_order, batch) AS BIGINT) AS last_order, arg_max(spent, batch) AS spent
    FROM rows GROUP BY custkey"""


def customers(spark: SparkSession, sf_dir: str, parts: int = 16) -> PartitionedTable:
    """Customers, then two batches of what their orders changed, with a compaction between the two."""
    store = PartitionedTable(spark, scratch_path(spark, "customers"), ["custkey"], _SCHEMA, parts)
    store.write(
        table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("custkey"), F.lit(1).alias("batch"), F.lit(None).cast("long").alias("last_order"), F.col("c_acctbal").alias("spent")
        ), 1,
    )
    orders = table(spark, sf_dir, "orders")
    for batch in (2, 3):
        changed = orders.where(F.col("o_orderkey") % 2 == batch - 2).groupBy(F.col("o_custkey").alias("custkey"))
        store.write(changed.agg(F.lit(batch).alias("batch"), F.max("o_orderkey").alias("last_order"), F.max("o_totalprice").alias("spent")), batch)
        if batch == 2:
            store.maintain(changes=2, keep=1)
    return store


@query("store_upsert", _SQL)
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).read()


@query("store_lookup", f"SELECT * FROM ({_SQL}) WHERE custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("custkey"))
    return customers(spark, sf_dir).lookup(wanted)


def known_keys(spark: SparkSession, stored: DataFrame, parts: int = 16) -> dict[str, PartitionedTable]:
    """Indexed tables of the article keys and content keys of ``stored`` (``article_key, content_key, seq``), in two versions."""
    tables = {}
    for key in ("article_key", "content_key"):
        tables[key] = PartitionedTable(spark, scratch_path(spark, key), [key], f"{key} STRING, first_seq BIGINT", parts, indexed=True)
        rows = stored.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("seq.event_seq").alias("first_seq"))
        tables[key].write(rows.where("first_seq % 3 > 0"), 1)
        tables[key].compact()
        tables[key].write(rows.where("first_seq % 3 = 0"), 2)
    return tables


@query("duplicate_hint_indexed", ORACLES["duplicate_hint"])
def duplicate_hint_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, stored = A.hinted_batch(spark, sf_dir)
    return flag_duplicates_in(batch, known_keys(spark, stored)).select("event_seq", "seq.source_pos", "duplicate_hint")


_LISTS = "(SELECT concat_ws('-', 'k', lang, n_chars) AS k, max(doc_id) AS doc_id FROM documents WHERE doc_id % 3 <> 0 AND {} GROUP BY 1)"


@query(
    "author_bridge_changes",
    f"""WITH one AS {_LISTS.format("doc_id % 2 = 0")}, two AS {_LISTS.format("doc_id % 2 = 1")},
        names AS (SELECT doc_id, p AS position, CASE p WHEN 1 THEN source ELSE concat('zoe ', lang) END AS normalized_name FROM documents, (VALUES (1), (2)) v(p)),
        before AS (SELECT k AS article_key, position, normalized_name FROM one JOIN names USING (doc_id) WHERE k IN (SELECT k FROM two)),
        after AS (SELECT k AS article_key, position, normalized_name FROM two JOIN names USING (doc_id))
        SELECT *, 'delete' AS change FROM (FROM before EXCEPT FROM after) UNION ALL SELECT *, 'insert' AS change FROM (FROM after EXCEPT FROM before)""",
)
def author_bridge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.bridge_changes(author_versions(spark, sf_dir).changes(1, 2))


def author_versions(spark: SparkSession, sf_dir: str) -> PartitionedTable:
    """Author lists of articles after a batch of the even documents and one of the odd ones."""
    lists = PartitionedTable(spark, scratch_path(spark, "lists"), ["article_key"], "article_key STRING, authors ARRAY<STRING>", 16)
    rows = A.batch_candidates(table(spark, sf_dir, "documents")).withColumn("resolved_key", F.col("article_key"))
    lists.write(merge.last_author_lists(rows.where("seq % 2 = 0")), 1)
    lists.write(merge.last_author_lists(rows.where("seq % 2 = 1")), 2)
    return lists
