"""Fold resolved candidates into the article store and its satellite tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.language import is_unknown
from feedloom.functions.text import UNKNOWN, identity_text
from feedloom.functions.urls import url_variants
from feedloom.operators.skew import restrict, salted_join

ARTICLE_COLUMNS = [
    "article_key", "content_key", "published_at", "ingested_at", "canonical_url", "title", "summary",
    "image_url", "country", "language", "company_id",
]


def _first(col: str, keep: Column) -> Column:
    return F.min_by(col, F.when(keep, F.col("seq"))).alias(col)


def _last(col: str, keep: Column) -> Column:
    return F.max_by(col, F.when(keep, F.col("seq"))).alias(col)


def fold_updates(resolved: DataFrame) -> DataFrame:
    """One row per article touched by a root candidate: what the batch knows about each field.

    Every rule is a first or last value in ``seq`` order, so partial aggregation carries it.
    """
    has = lambda c: F.col(c).isNotNull()
    filled = lambda c: F.col(c) != ""
    return resolved.where("is_root").groupBy("resolved_key").agg(
        _first("published_at", has("published_at")),
        _first("content_key", filled("content_key")),
        _last("canonical_url", filled("canonical_url")),
        _last("title", filled("title")),
        _last("summary", has("summary")),
        _last("image_url", has("image_url")),
        _last("company_id", has("company_id")),
        _last("country", filled("country")),
        _first("language", ~is_unknown(F.col("language"))),
    ).withColumnRenamed("resolved_key", "article_key")


def _merged(articles: DataFrame, resolved: DataFrame, as_of: Column, how: str) -> DataFrame:
    new = fold_updates(resolved)
    new = new.select("article_key", *[F.col(c).alias(f"_{c}") for c in new.columns[1:]], F.lit(True).alias("_hit"))
    old = articles.select(*ARTICLE_COLUMNS, F.lit(True).alias("_stored"))
    both = old.join(new, "article_key", how)
    known = F.when(~is_unknown(F.col("language")), F.col("language"))
    touched = lambda c, value: F.when(F.col("_hit").isNull(), F.col(c)).otherwise(value)
    fields = {
        "published_at": F.coalesce("published_at", "_published_at"),
        "content_key": F.coalesce("content_key", "_content_key"),
        "ingested_at": F.when(F.col("_stored").isNull(), as_of).otherwise(F.col("ingested_at")),
        "canonical_url": F.coalesce("_canonical_url", "canonical_url"),
        "title": F.coalesce("_title", "title"),
        "summary": F.coalesce("_summary", "summary"),
        "image_url": F.coalesce("_image_url", "image_url"),
        "company_id": F.coalesce("_company_id", "company_id"),
        "country": touched("country", F.coalesce("_country", "country", F.lit(UNKNOWN))),
        "language": touched("language", F.coalesce(known, "_language", F.lit(UNKNOWN))),
    }
    return both.select(*[fields[c].alias(c) if c in fields else F.col(c) for c in ARTICLE_COLUMNS])


def changed_articles(articles: DataFrame, resolved: DataFrame, as_of: Column) -> DataFrame:
    """The articles a batch inserts or updates, as they are after it.

    Stored publication, content key and known language stay; other fields take the batch's last usable
    value. ``as_of`` becomes ``ingested_at`` of new articles.
    """
    touched = resolved.where("is_root").select(F.col("resolved_key").alias("article_key"))
    return _merged(restrict(articles, touched, ["article_key"]), resolved, as_of, "right")


def merge_articles(articles: DataFrame, resolved: DataFrame, as_of: Column) -> DataFrame:
    """The whole article store after a batch, by the rules of :func:`changed_articles`."""
    return _merged(articles, resolved, as_of, "full_outer")


def author_dim(resolved: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Authors by ``normalized_name``; the first display name ever seen stays."""
    named = resolved.select("seq", F.posexplode("authors").alias("pos", "display_name")).select(
        F.struct("seq", "pos").alias("at"),
        "display_name",
        identity_text(F.col("display_name")).alias("normalized_name"),
    )
    first = named.where(F.col("normalized_name").isNotNull()).groupBy("normalized_name").agg(
        F.min_by("display_name", "at").alias("display_name")
    )
    if previous is None:
        return first
    old = previous.select("normalized_name", F.col("display_name").alias("_old"))
    return first.join(old, "normalized_name", "full_outer").select(
        "normalized_name", F.coalesce("_old", "display_name").alias("display_name")
    )


def last_author_lists(resolved: DataFrame) -> DataFrame:
    """``(article_key, authors)``: the last non-empty author list of each article, as identity texts in order.

    A list with the same names in the same order as the stored one gives the same row, so nothing needs comparing.
    """
    last = (
        resolved.where(F.size("authors") > 0)
        .groupBy(F.col("resolved_key").alias("article_key"))
        .agg(F.max_by("authors", "seq").alias("authors"))
    )
    return last.withColumn("authors", F.transform("authors", identity_text))


def author_bridge(lists: DataFrame) -> DataFrame:
    """``(article_key, position, normalized_name)`` with positions from 1."""
    return lists.select("article_key", F.posexplode("authors").alias("pos", "normalized_name")).select(
        "article_key", (F.col("pos") + 1).alias("position"), "normalized_name"
    )


def bridge_changes(lists: DataFrame) -> DataFrame:
    """Rows that enter or leave the bridge between two versions of the author lists.

    ``lists`` has ``article_key`` and the rows ``before`` and ``after`` with their ``authors``. Returns ``article_key,
    position, normalized_name, change`` (``insert`` or ``delete``); a list that stayed gives nothing.
    """

    def placed(row: str) -> Column:
        names = F.coalesce(F.col(row)["authors"], F.array().cast("array<string>"))
        return F.transform(names, lambda name, i: F.struct((i + 1).alias("position"), name.alias("normalized_name")))

    rows = lists.select("article_key", placed("before").alias("old"), placed("after").alias("new"))
    mark = lambda rows, change: F.transform(rows, lambda r: F.struct(r["position"].alias("position"), r["normalized_name"].alias("normalized_name"), F.lit(change).alias("change")))
    both = F.concat(mark(F.array_except("old", "new"), "delete"), mark(F.array_except("new", "old"), "insert"))
    return rows.select("article_key", F.inline(both))


def apply_bridge_changes(bridge: DataFrame, changes: DataFrame) -> DataFrame:
    """The bridge after ``changes``."""
    names = ["article_key", "position", "normalized_name"]
    gone = changes.where("change = 'delete'").select(names)
    return bridge.join(gone, names, "left_anti").select(names).unionByName(changes.where("change = 'insert'").select(names))


def author_lists(bridge: DataFrame, authors: DataFrame) -> DataFrame:
    """Display names of each article in position order."""
    named = salted_join(bridge, authors, "normalized_name", spread=["article_key", "position"], how="inner")
    return named.groupBy("article_key").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "display_name"))), lambda a: a["display_name"]
        ).alias("authors")
    )


def feed_links(resolved: DataFrame, seen_at: Column, previous: DataFrame | None = None) -> DataFrame:
    """``(article_key, feed_id, first_seen_at)``; the first sighting stays."""
    seen = resolved.select(F.col("resolved_key").alias("article_key"), "feed_id", seen_at.alias("first_seen_at"))
    new = seen.groupBy("article_key", "feed_id").agg(F.min("first_seen_at").alias("first_seen_at"))
    if previous is None:
        return new
    return previous.unionByName(new).groupBy("article_key", "feed_id").agg(F.min("first_seen_at").alias("first_seen_at"))


def url_owners(resolved: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """``(url, article_key)``; the last writer owns a URL."""
    urls = resolved.select(
        "seq", F.col("resolved_key").alias("article_key"), F.explode(url_variants(F.col("source_urls"))).alias("url")
    )
    new = urls.groupBy("url").agg(F.max_by("article_key", "seq").alias("article_key"))
    if previous is None:
        return new
    kept = previous.select("url", F.col("article_key").alias("_old"))
    return new.join(kept, "url", "full_outer").select("url", F.coalesce("article_key", "_old").alias("article_key"))
