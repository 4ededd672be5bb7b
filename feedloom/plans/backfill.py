"""Queries on the language backfill and the text model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.language import country_language, detection_text
from feedloom.operators.language import (
    assign_language,
    backfill_language,
    backfill_metrics,
    model_detector,
    train_detector,
)
from feedloom.plans import mapping as M
from feedloom.plans.registry import query, table


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles; some languages are blank, unknown or missing."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        n,
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("summary"),
        M.country_of(n).alias("country"),
        F.when(n % 4 != 0, F.concat(F.lit("https://x.example/"), F.when(n % 2 == 0, F.col("lang")).otherwise("a"), F.lit("/"), n)).alias("canonical_url"),
        F.when(n % 5 == 0, "").when(n % 5 == 1, "xx").when(n % 5 == 2, F.lit(None)).otherwise(F.col("lang")).alias("language"),
    )


_BACKFILL = """
    found AS (
        SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'xx' WHEN 2 THEN NULL ELSE lang END AS old,
            coalesce(list_extract(['fr', 'it', NULL, NULL, 'en', 'de', NULL, NULL, 'fr', NULL, 'ja', 'sv', NULL, 'en', NULL, 'es', 'pt', NULL, 'nl', NULL, 'el', 'no', NULL, 'ko', NULL],
                CAST(doc_id % 25 AS INTEGER) + 1), CASE WHEN doc_id % 4 = 2 THEN lang END, 'xx') AS new,
        FROM documents),
    filled AS (SELECT *, doc_id % 5 < 3 AS scanned, doc_id % 5 < 3 AND new <> 'xx' AS updated FROM found)
"""


@query(
    "language_backfill",
    f"WITH {_BACKFILL} SELECT doc_id, CASE WHEN updated THEN new ELSE old END AS language, scanned, updated FROM filled",
)
def language_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backfill_language(_articles(spark, sf_dir), key="doc_id").select("doc_id", "language", "scanned", "updated")


@query(
    "language_backfill_metrics",
    f"""WITH {_BACKFILL} SELECT count(*) FILTER (scanned) AS scanned_count, count(*) FILTER (updated) AS updated_count,
        max(doc_id) FILTER (scanned) AS last_id FROM filled""",
)
def language_backfill_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backfill_metrics(backfill_language(_articles(spark, sf_dir), key="doc_id"), key="doc_id")


@query(
    "language_backfill_batch",
    f"""WITH {_BACKFILL}, batch AS (SELECT * FROM filled WHERE scanned AND doc_id > 100 ORDER BY doc_id LIMIT 500)
        SELECT count(*) AS scanned_count, count(*) FILTER (updated) AS updated_count, max(doc_id) AS last_id FROM batch""",
)
def language_backfill_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = backfill_language(_articles(spark, sf_dir), start_after=100, limit=500, key="doc_id")
    return backfill_metrics(batch, key="doc_id")


@query(
    "language_detected",
    """WITH texts AS (
            SELECT doc_id, concat_ws(chr(10) || chr(10), nullif(trim(string_split(text, chr(10))[1]), ''), nullif(trim(text, ' ' || chr(10) || chr(9)), '')) AS t FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 25 = 0 THEN 'fr' WHEN t = '' THEN 'xx' WHEN length(t) % 3 = 0 THEN 'de' WHEN length(t) % 3 = 1 THEN 'arz' ELSE 'xx' END AS language
        FROM texts""",
)
def language_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade with a detector that goes by the length of the text."""
    n, size = F.col("doc_id"), F.length("text") % 3
    label = F.when(size == 0, "__label__DE").when(size == 1, "arz").otherwise("engl")
    title = F.substring_index("text", "\n", 1)
    asked = table(spark, sf_dir, "documents").select(
        n,
        country_language(F.when(n % 25 == 0, "fr").otherwise("eu")).alias("declared"),
        detection_text(title, F.col("text")).alias("text"),
    )
    return assign_language(asked, lambda df: df.withColumn("label", label))


@query("language_model_eval")
def language_model_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages the model, trained on all documents, finds for all pages, next to the language pages declare."""
    docs = table(spark, sf_dir, "documents", spread=True).select("text", "lang")
    html = F.regexp_replace("html", "(?is)<(script|style)\\b.*?</\\1>", " ")
    pages = table(spark, sf_dir, "pages", spread=True).select(
        F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_replace(html, "(?s)<[^>]*>", " ").alias("text"),
    )
    detect = model_detector(train_detector(docs))
    return detect(pages).groupBy("lang", F.col("label").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
