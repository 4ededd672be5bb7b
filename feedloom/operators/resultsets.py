"""Entity resolution of many result sets in one job, as if they came one after the other.

In a result set the maps from keys to articles start empty (see :mod:`feedloom.operators.resolve`), and what a set looks
up is the store as the sets before it left it. So every set depends on all earlier ones, but only through three facts of an
article: since which set it exists, and since which set it has its content key and its publication. Each fact changes once.

The job iterates on these facts. With the facts of the round before, every set looks up the store *as of* its own turn, all
sets are resolved at once, and the facts are collected anew from the rows that write articles. The first set only depends
on the store, so it is right from the first round on; a set is right one round after the last set it depends on. When a
round changes no fact, its rows are those of the sequential walk. A key or a content that runs through all sets takes two
or three rounds, not one for each set.

All lookups move both sides by key: what a round joins is as large as the candidates, and broadcasts, small ones too, would
pass the driver in every round. A set's own maps are kept apart by prefixing keys with the set, and the best article of a content
as of a set is a running maximum over the events of this content, folded in chunks so that one content may hold a third of
all rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.resolve import resolve
from feedloom.operators.skew import CHUNK_ROWS, earlier, hinted, restrict
from feedloom.session import cut_lineage

#: Since when a fact of an article holds that was stored before the first set.
ALWAYS = -1
_GAP = "\x1f"
#: How the tables of a round are joined.
_BY_KEY = "merge"


def _in_set(key: str) -> Column:
    """A key that is equal only within one set."""
    return F.concat(F.col("set_id").cast("string"), F.lit(_GAP), F.col(key))


def _after_gap(col: str) -> Column:
    return F.expr(f"substring(`{col}`, instr(`{col}`, '{_GAP}') + 1)")


def _stored_facts(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """The stored articles that a candidate can reach by its article key or its content key."""
    named = candidates.select("article_key")
    contents = candidates.where("content_key <> ''").select("content_key")
    columns = articles.select("article_key", "content_key", "published_at", "ingested_at")
    found = restrict(columns, named, ["article_key"], hint=_BY_KEY).unionByName(restrict(columns, contents, ["content_key"], hint=_BY_KEY))
    return found.groupBy("article_key").agg(*(F.max(c).alias(c) for c in ("content_key", "published_at", "ingested_at")))


def _facts(stored: DataFrame, resolved: DataFrame | None, as_of: Column) -> DataFrame:
    """One row per article: what is known of it, and since which set.

    ``resolved`` are the rows of a round; the first value in row order counts, a stored one before all others.
    """
    columns = ["article_key", "content_key", "published_at", "ingested_at", "exists_since", "content_since", "published_since"]
    always = F.lit(ALWAYS).cast("long")
    known = stored.select(
        "article_key", "content_key", "published_at", "ingested_at", always.alias("exists_since"),
        F.when(F.col("content_key").isNotNull(), always).alias("content_since"),
        F.when(F.col("published_at").isNotNull(), always).alias("published_since"),
    )
    if resolved is None:
        return known.select(columns)
    content = F.when(F.col("content_key") != "", F.col("content_key"))
    written = resolved.where("is_root").select(
        F.col("resolved_key").alias("article_key"), "seq", "set_id", content.alias("content_key"), "published_at"
    )

    def first(col: str, by: str) -> Column:
        return F.min_by(col, F.when(F.col(by).isNotNull(), F.col("seq")))

    new = written.groupBy("article_key").agg(
        F.min("set_id").alias("_exists"),
        first("content_key", "content_key").alias("_content"), first("set_id", "content_key").alias("_content_since"),
        first("published_at", "published_at").alias("_published"), first("set_id", "published_at").alias("_published_since"),
    )
    return known.join(hinted(new, _BY_KEY), "article_key", "full_outer").select(
        "article_key",
        F.coalesce("content_key", "_content").alias("content_key"),
        F.coalesce("published_at", "_published").alias("published_at"),
        F.when(F.col("exists_since").isNull(), as_of).otherwise(F.col("ingested_at")).alias("ingested_at"),
        F.coalesce("exists_since", "_exists").alias("exists_since"),
        F.coalesce("content_since", "_content_since").alias("content_since"),
        F.coalesce("published_since", "_published_since").alias("published_since"),
    )


def _state(facts: DataFrame) -> tuple:
    row = F.xxhash64(*[c for c in facts.columns if c != "ingested_at"])
    return tuple(facts.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first())


def _store_of_sets(named: DataFrame, contents: DataFrame, facts: DataFrame, chunk_sets: int) -> DataFrame:
    """What each set finds stored before its turn, as a store whose keys are those of :func:`_in_set`.

    ``named`` and ``contents`` are the distinct article keys and content keys of each set.
    """
    since = facts.select("article_key", "exists_since")
    by_key = named.join(hinted(since, _BY_KEY), "article_key").where("exists_since < set_id").select("set_id", "article_key", F.lit(None).cast("string").alias("content_key"))
    # An article enters the race for its content when it has it, and once more when its publication is known.
    late = F.col("published_since") > F.col("content_since")
    at_first = F.struct(F.when(~F.coalesce(late, F.lit(True)), F.col("published_at")).alias("published_at"), "ingested_at", "article_key")
    later = F.struct("published_at", "ingested_at", "article_key")
    has = facts.where("content_since IS NOT NULL")
    # A probe is even and an event odd, so a set sees the events of earlier sets only.
    events = has.select("content_key", (F.col("content_since") * 2 + 1).alias("turn"), at_first.alias("rank"))
    events = events.unionByName(has.where(late).select("content_key", (F.col("published_since") * 2 + 1).alias("turn"), later.alias("rank")))
    probes = contents.select("content_key", (F.col("set_id") * 2).alias("turn"), F.lit(None).cast(events.schema["rank"].dataType).alias("rank"))
    chunk = F.floor(F.col("turn") / (2 * chunk_sets))
    raced = earlier(events.unionByName(probes), "content_key", "turn", chunk, F.col("rank"), F.max, lambda a, b: F.greatest(a, b), "best")
    best = raced.where("turn % 2 = 0 AND best IS NOT NULL").select(
        (F.col("turn") / 2).cast("long").alias("set_id"), F.col("best.article_key").alias("article_key"), "content_key"
    )
    found = by_key.unionByName(best).groupBy("set_id", "article_key").agg(F.max("content_key").alias("content_key"))
    nothing = F.lit(None).cast("timestamp")
    return found.select(
        _in_set("article_key").alias("article_key"), _in_set("content_key").alias("content_key"),
        nothing.alias("published_at"), nothing.alias("ingested_at"),
    )


def resolve_sets(
    candidates: DataFrame,
    articles: DataFrame,
    as_of: Column,
    chunk_rows: int = CHUNK_ROWS,
    order: str = "seq",
    root: str | None = None,
    chunk_sets: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``resolved_key`` and ``is_root`` to every candidate, set by set.

    ``set_id`` is a non-negative whole number below 2**62 that does not fall along ``seq``; ``as_of`` is when the store gets
    new articles, which breaks ties between articles of one content. The candidates are read several times, so store them
    first. The rows do not depend on how consecutive sets are put into batches, as long as a set is whole. An empty table
    gives no rows; a null content key, or an empty one, leads to no article.
    """
    cut = partial(cut_lineage, root=root)
    stored = cut(_stored_facts(candidates, articles))
    named = cut(candidates.select("set_id", "article_key").distinct())
    contents = cut(candidates.where("content_key <> ''").select("set_id", "content_key").distinct())
    narrow = candidates.select(
        *dict.fromkeys(["seq", order, "set_id", "published_at"]), "content_key",
        _in_set("article_key").alias("article_key"), _in_set("content_key").alias("set_content"),
    )
    rows = cut(narrow.withColumn("set_content", F.when(F.col("content_key") != "", F.col("set_content"))))
    facts = cut(_facts(stored, None, as_of))
    state = _state(facts)
    while True:
        looked_up = cut(_store_of_sets(named, contents, facts, chunk_sets))
        sets = rows.withColumnRenamed("content_key", "own_content").withColumnRenamed("set_content", "content_key")
        found = resolve(sets, looked_up, chunk_rows, order, root, _BY_KEY)
        own = F.col("own_content").alias("content_key")
        resolved = cut(found.select("seq", "set_id", "published_at", own, _after_gap("resolved_key").alias("resolved_key"), "is_root"))
        facts = cut(_facts(stored, resolved, as_of))
        before, state = state, _state(facts)
        if state == before:  # what the sets looked up is what they left
            return candidates.join(hinted(resolved.select("seq", "resolved_key", "is_root"), _BY_KEY), "seq")
