"""Candidate rows: one per usable source of a result event, with keys, language and duplicate hint."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.authors import clean_authors
from feedloom.functions.keys import article_key, content_key
from feedloom.functions.language import declared_language, detection_text
from feedloom.functions.text import UNKNOWN, known_or_unknown
from feedloom.functions.urls import image_url, primary_url
from feedloom.operators.language import Detector, assign_language
from feedloom.operators.skew import lookup, restrict


def feed_context(feeds: DataFrame, companies: DataFrame) -> DataFrame:
    """Feeds (``id, url, company_id``) with name and country of their company (``id, name, country``)."""
    company = companies.select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"), F.col("country").alias("_country")
    )
    feed = feeds.select(F.col("id").alias("feed_id"), F.col("url").alias("feed_url"), "company_id")
    return feed.join(company, "company_id", "left").select(
        "feed_id", "feed_url", "company_id", "company_name", known_or_unknown(F.col("_country")).alias("country")
    )


def build_candidates(events: DataFrame, contexts: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Explode the sources of result events in order and derive every candidate column.

    ``events`` has ``event_seq`` (a dense ingest number), ``feed_id`` and ``sources``. ``contexts`` comes from
    :func:`feed_context`. ``seq`` is the total order ``(event_seq, source_pos)`` later steps rely on.
    """
    known = lookup(events, contexts, "feed_id", spread=["event_seq"])
    rows = known.select(
        "event_seq",
        "feed_id",
        "feed_url",
        "company_id",
        "company_name",
        F.coalesce("country", F.lit(UNKNOWN)).alias("country"),
        F.posexplode("sources").alias("source_pos", "s"),
    )
    urls = F.col("s.urls")
    hinted = F.concat(urls, F.filter(F.array("feed_url"), lambda u: u.isNotNull()))
    derived = rows.select(
        F.struct("event_seq", "source_pos").alias("seq"),
        "event_seq",
        "feed_id",
        F.col("s.published_at").alias("published_at"),
        primary_url(urls).alias("canonical_url"),
        urls.alias("source_urls"),
        F.col("s.title").alias("title"),
        F.col("s.summary").alias("summary"),
        clean_authors("s.authors", "s.author").alias("authors"),
        image_url(F.col("s.image_url")).alias("image_url"),
        "company_id",
        "company_name",
        "country",
        declared_language(F.col("country"), hinted).alias("declared"),
        detection_text(F.col("s.title"), F.col("s.summary")).alias("text"),
    ).where(F.col("canonical_url").isNotNull())
    derived = assign_language(derived, detector)
    return derived.select(
        "seq",
        "event_seq",
        "feed_id",
        article_key(
            F.col("canonical_url"), F.col("title"), F.col("authors"), F.col("company_name"), F.col("published_at")
        ).alias("article_key"),
        content_key(F.col("title"), F.col("summary"), F.col("company_name"), F.col("published_at")).alias("content_key"),
        "published_at",
        "canonical_url",
        "source_urls",
        "title",
        "summary",
        "authors",
        "image_url",
        "company_id",
        "country",
        "language",
    )


def flag_duplicates(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """Add ``duplicate_hint``: either key was seen earlier in the batch or is stored already.

    Only the first row of a key needs a look at the store, and only first rows carry a verdict back, joined on the
    unique ``seq``. So no row is ever grouped with the other rows of its key. The candidates are read several times.
    """

    def stored(key: str, first: DataFrame) -> DataFrame:
        return restrict(articles.where(F.col(key).isNotNull()), first, [key], unique=True).select(key).distinct()

    return _flagged(candidates, stored)


def flag_duplicates_in(candidates: DataFrame, tables: Mapping[str, Any]) -> DataFrame:
    """The same hint against keyed tables, one per key column and unique on it.

    With indexed tables the key filters answer for most new keys, and nothing is read for these.
    """
    return _flagged(candidates, lambda key, first: tables[key].lookup(first).select(key))


def _flagged(candidates: DataFrame, stored: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    def firsts(key: str, name: str) -> DataFrame:
        first = candidates.where(F.trim(key) != "").groupBy(key).agg(F.min("seq").alias("seq"))
        return first.join(stored(key, first).withColumn("_stored", F.lit(True)), key, "left").select(
            "seq", F.col("_stored").isNull().alias(name)
        )

    new_key = firsts("article_key", "_new_key")
    new_content = firsts("content_key", "_new_content")
    fresh = F.coalesce("_new_key", F.lit(False)) & (
        F.coalesce(F.trim("content_key") == "", F.lit(True)) | F.coalesce("_new_content", F.lit(False))
    )
    return (
        candidates.join(new_key, "seq", "left")
        .join(new_content, "seq", "left")
        .withColumn("duplicate_hint", ~fresh)
        .drop("_new_key", "_new_content")
    )
