"""Order-exact entity resolution of a candidate batch against the article store.

Walking the batch in ``seq`` order, a candidate joins (1) the article its article key was given earlier in the
batch, else (2) the article its content key was last given, else (3) the stored article with its key, else (4) the
best stored article with its content key, else it starts a new article. When (4) happens, the stored article's own
key is taken as seen too.

As a set-based plan: only the first row of each article key (its *head*) can take steps 2-4, so the work is on
heads, one per key. A head that finds its content key taken points at the last earlier row with that content which
is not such a head itself (its *anchor*); runs of copies of one content thus collapse to one hop. Anchors that are
repeats of some other key point on to that key's head, and these few pointers are resolved by doubling.

One deviation is known: when the batch fills a stored null ``published_at``, a row-at-a-time store would let that
value break later ties of step 4; here ties are broken by the values stored before the batch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.skew import CHUNK_ROWS, chunk_of, earlier, hinted, restrict, salted_join
from feedloom.session import cut_lineage

MAX_ROUNDS = 32

Cut = Callable[[DataFrame], DataFrame]


def best_by_content(articles: DataFrame) -> DataFrame:
    """Per content key the stored article with the newest publication (none last), then the newest entry."""
    rank = F.struct("published_at", "ingested_at", "article_key")
    return (
        articles.where(F.col("content_key").isNotNull())
        .groupBy("content_key")
        .agg(F.max(rank).alias("_best"))
        .select("content_key", F.col("_best.article_key").alias("stored_key"))
    )


def _heads(rows: DataFrame, articles: DataFrame, cut: Cut, hint: str | None = None) -> DataFrame:
    """One row per article key of the batch with its class and, where already known, its article."""
    first = rows.groupBy("article_key").agg(F.min(F.struct("seq", "content_key")).alias("_head"))
    first = cut(
        first.select(
            "article_key", F.col("_head.seq").alias("head_seq"), F.col("_head.content_key").alias("content_key")
        )
    )
    contents = cut(
        rows.where(F.col("content_key").isNotNull()).groupBy("content_key").agg(F.min("seq").alias("head_seq"))
    )
    best = best_by_content(restrict(articles, contents, ["content_key"], True, hint))
    openers = contents.join(hinted(best, hint), "content_key", "left").select(
        "head_seq", "stored_key", F.lit(True).alias("opens_content")
    )
    stored = restrict(articles, first, ["article_key"], True, hint).select("article_key").withColumn("_stored", F.lit(True))
    heads = first.join(hinted(stored, hint), "article_key", "left").join(hinted(openers, hint), "head_seq", "left")
    opens = F.coalesce("opens_content", F.lit(False))
    heads = cut(
        heads.select(
            "article_key",
            "head_seq",
            "content_key",
            F.col("_stored").isNotNull().alias("is_stored"),
            F.when(F.col("_stored").isNull() & opens, F.col("stored_key")).alias("stored_key"),
            (F.col("content_key").isNotNull() & ~opens).alias("content_taken"),
        )
    )
    # A stored article found by content is the best one of a single content key, so it is found at most once.
    alias = heads.where(F.col("stored_key").isNotNull()).select(
        F.col("stored_key").alias("article_key"), F.col("head_seq").alias("alias_seq")
    )
    heads = heads.join(hinted(alias, hint), "article_key", "left")
    aliased = F.coalesce(F.col("alias_seq") < F.col("head_seq"), F.lit(False))
    follows = ~aliased & F.col("content_taken")
    return heads.select(
        "article_key",
        "head_seq",
        "alias_seq",
        follows.alias("follows"),
        (~aliased & ~follows).alias("is_root"),
        F.when(~follows, F.coalesce("stored_key", "article_key")).alias("target"),
    )


def _anchors(rows: DataFrame, heads: DataFrame, chunk_rows: int, order: str, hint: str | None = None) -> DataFrame:
    """For each following head the key and position of its anchor."""
    followers = heads.where("follows").select(F.col("head_seq").alias("seq"), F.lit(True).alias("follows"))
    marked = rows.where(F.col("content_key").isNotNull()).join(hinted(followers, hint), "seq", "left")
    anchor = F.when(F.col("follows").isNull(), F.struct("seq", "article_key"))
    found = earlier(
        marked, "content_key", "seq", chunk_of(order, chunk_rows), anchor, F.max, lambda a, b: F.coalesce(a, b), "anchor"
    )
    return found.where("follows").select(
        "article_key", F.col("anchor.seq").alias("anchor_seq"), F.col("anchor.article_key").alias("next_key")
    )


def _links(anchors: DataFrame, heads: DataFrame, hint: str | None = None) -> DataFrame:
    """Following heads with their article, or with the key whose head decides it."""
    end = heads.select(F.col("article_key").alias("next_key"), "alias_seq", F.col("target").alias("_target"))
    joined = salted_join(anchors, end, "next_key", spread=["article_key"], hint=hint)
    aliased = F.coalesce(F.col("alias_seq") < F.col("anchor_seq"), F.lit(False))
    return joined.select(
        "article_key", "next_key", F.when(aliased, F.col("next_key")).otherwise(F.col("_target")).alias("target")
    )


def _double(links: DataFrame, cut: Cut, hint: str | None = None) -> DataFrame:
    """Follow the open links until each has an article; the open part halves its distance every round."""
    done = links.where(F.col("target").isNotNull())
    still_open = links.where(F.col("target").isNull())
    for _ in range(MAX_ROUNDS):
        if still_open.isEmpty():
            return done.select("article_key", "target")
        known = done.unionByName(still_open).select(
            F.col("article_key").alias("next_key"), F.col("target").alias("_target"), F.col("next_key").alias("_next")
        )
        moved = cut(
            salted_join(still_open.drop("target"), known, "next_key", spread=["article_key"], how="inner", hint=hint).select(
                "article_key", F.col("_next").alias("next_key"), F.col("_target").alias("target")
            )
        )
        done = done.unionByName(moved.where(F.col("target").isNotNull()))
        still_open = moved.where(F.col("target").isNull())
    raise RuntimeError(f"article links are not resolved after {MAX_ROUNDS} rounds")


def resolve(
    candidates: DataFrame,
    articles: DataFrame,
    chunk_rows: int = CHUNK_ROWS,
    order: str = "seq",
    root: str | None = None,
    hint: str | None = None,
) -> DataFrame:
    """Add ``resolved_key`` and ``is_root`` (the row writes article fields) to every candidate.

    ``seq`` is the unique total order of the batch; ``order`` is the dense integer column it sorts by first. The
    candidates are read several times, so store them first if they are costly. ``root`` takes the intermediate tables.
    ``hint`` is the join hint of all lookups, ``merge`` where they are many and none should be a broadcast.
    """
    cut = partial(cut_lineage, root=root)
    content = F.when(F.col("content_key") != "", F.col("content_key")).alias("content_key")
    rows = candidates.select(*dict.fromkeys(["seq", order]), "article_key", content)
    heads = cut(_heads(rows, articles, cut, hint))
    anchors = cut(_anchors(rows, heads, chunk_rows, order, hint))
    links = cut(_links(anchors, heads, hint))
    followed = _double(links, cut, hint).withColumnRenamed("target", "_followed")
    final = heads.join(hinted(followed, hint), "article_key", "left").select(
        "article_key", "head_seq", "alias_seq", "is_root", F.coalesce("target", "_followed").alias("_target")
    )
    joined = salted_join(candidates, final, "article_key", spread=["seq"], hint=hint)
    aliased = F.coalesce(F.col("alias_seq") < F.col("seq"), F.lit(False))
    return (
        joined.withColumn("resolved_key", F.when(aliased, F.col("article_key")).otherwise(F.col("_target")))
        .withColumn("is_root", F.col("is_root") & (F.col("seq") == F.col("head_seq")))
        .drop("head_seq", "alias_seq", "_target")
    )
