"""One batch of results into the article store and its satellite tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import merge
from feedloom.operators.candidates import build_candidates
from feedloom.operators.feeds import feed_runtime
from feedloom.operators.language import Detector
from feedloom.operators.quality import split_valid
from feedloom.operators.resolve import resolve
from feedloom.operators.resultsets import resolve_sets
from feedloom.operators.skew import CHUNK_ROWS
from feedloom.schemas import ARTICLES, FEED_RUNTIME
from feedloom.session import cut_lineage, scratch
from feedloom.sources.results import parse_results, result_events
from feedloom.sources.partitioned import PartitionedTable
from feedloom.sources.store import KeyedTable

Table = KeyedTable | PartitionedTable

# Room for the events of one envelope in an event number, and envelopes per chunk of an ordered fold.
EVENT_BITS = 20
MAX_ENVELOPE = 1 << (63 - EVENT_BITS)
ENVELOPES_PER_CHUNK = 4_096


@dataclass(frozen=True)
class FeedStore:
    """The tables a batch writes, below one root."""

    articles: Table
    authors: Table
    author_lists: Table
    feed_links: Table
    urls: Table
    runtime: Table

    def tables(self) -> tuple[Table, ...]:
        return self.articles, self.authors, self.author_lists, self.feed_links, self.urls, self.runtime

    def compact(self, version: int) -> None:
        """Fold the changes of every table up to ``version`` into a new base."""
        for table in self.tables():
            table.compact(version)

    @staticmethod
    def at(spark: SparkSession, root: str, parts: int | None = None) -> FeedStore:
        """Tables below ``root``; with ``parts`` in so many hash partitions each, so that a batch reads those of its keys."""

        def table(name: str, keys: list[str], schema: str) -> Table:
            if parts is None:
                return KeyedTable(spark, f"{root}/{name}", keys, schema)
            return PartitionedTable(spark, f"{root}/{name}", keys, schema, parts)

        return FeedStore(
            articles=table("articles", ["article_key"], ARTICLES),
            authors=table("authors", ["normalized_name"], "normalized_name STRING, display_name STRING"),
            author_lists=table("author_lists", ["article_key"], "article_key STRING, authors ARRAY<STRING>"),
            feed_links=table(
                "feed_links", ["article_key", "feed_id"], "article_key STRING, feed_id BIGINT, first_seen_at TIMESTAMP"
            ),
            urls=table("urls", ["url"], "url STRING, article_key STRING"),
            runtime=table("runtime", ["feed_id"], FEED_RUNTIME),
        )


def ingest_candidates(
    candidates: DataFrame,
    store: FeedStore,
    version: int,
    as_of: Column,
    chunk_rows: int = CHUNK_ROWS,
    order: str = "event_seq",
) -> None:
    """Merge a candidate batch as ``version``, reading the store as of the version before.

    Candidates with a ``set_id`` are resolved set by set, each against the store that the sets before it left; others as one
    set. Each table gets only its changed rows. Running the same version again gives the same store.
    """
    with scratch(candidates.sparkSession) as root:
        articles = store.articles.read(version - 1)
        batch = cut_lineage(candidates, root)
        if "set_id" in batch.columns:
            resolved = resolve_sets(batch, articles, as_of, chunk_rows, order, root, ENVELOPES_PER_CHUNK)
        else:
            resolved = resolve(batch, articles, chunk_rows, order, root)
        _write(cut_lineage(resolved, root), articles, store, version, as_of)


def _write(resolved: DataFrame, articles: DataFrame, store: FeedStore, version: int, as_of: Column) -> None:
    store.articles.write(merge.changed_articles(articles, resolved, as_of), version)
    store.authors.write(_new_rows(merge.author_dim(resolved), store.authors, version), version)
    store.author_lists.write(merge.last_author_lists(resolved), version)
    store.feed_links.write(_new_rows(merge.feed_links(resolved, as_of), store.feed_links, version), version)
    store.urls.write(merge.url_owners(resolved), version)


def _new_rows(rows: DataFrame, table: Table, version: int) -> DataFrame:
    """The rows whose keys the table did not have before ``version``."""
    return rows.join(table.lookup(rows, version - 1), list(table.keys), "left_anti")


def update_runtime(results: DataFrame, table: Table, version: int, chunk_rows: int = CHUNK_ROWS) -> None:
    """Fold a batch of results into the stored feed health."""
    before = table.lookup(results, version - 1)
    changed = feed_runtime(results, before, chunk_rows)
    table.write(changed.join(results.select("feed_id").distinct(), "feed_id", "left_semi"), version)


def ingest_events(
    events: DataFrame,
    contexts: DataFrame,
    store: FeedStore,
    version: int,
    as_of: Column,
    detector: Detector | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> None:
    """Candidates, merge and feed health for a batch of valid result events numbered by :func:`number_events`.

    Every envelope is a result set of its own, so the store does not depend on how envelopes are dealt to batches.
    """
    candidates = build_candidates(events, contexts, detector).withColumn("set_id", F.shiftright("event_seq", EVENT_BITS))
    ingest_candidates(candidates, store, version, as_of, chunk_rows)
    results = events.select(
        "feed_id",
        F.col("event_seq").alias("seq"),
        as_of.alias("at"),
        "status",
        "status_code",
        F.col("new_etag").alias("etag"),
        F.col("new_last_update").alias("feed_update"),
        F.array_max(F.transform("sources", lambda s: s["published_at"])).alias("article_at"),
    )
    update_runtime(results, store.runtime, version, chunk_rows)


def number_events(envelopes: DataFrame) -> DataFrame:
    """Result events of valid envelopes with ``event_seq``, their place in the total order.

    The number has room for 2**20 events of an envelope and for ids from 0 to 2**43 - 1; others end the job with an error.
    """
    number = F.shiftleft(F.col("envelope_id"), EVENT_BITS) + F.col("event_pos")
    room = (F.col("event_pos") < (1 << EVENT_BITS)) & F.col("envelope_id").between(0, MAX_ENVELOPE - 1)
    fits = F.assert_true(room, F.lit("too many events in one envelope, or an envelope id out of range"))
    return result_events(envelopes).withColumn("event_seq", F.when(fits.isNull(), number))


def ingest_envelopes(
    raw: DataFrame,
    contexts: DataFrame,
    store: FeedStore,
    quarantine: str,
    version: int,
    as_of: Column,
    detector: Detector | None = None,
) -> None:
    """A batch of JSON envelopes (``envelope_id, body``) to the store; rejected ones to ``quarantine``."""
    good, bad = split_valid(parse_results(raw))
    bad.write.mode("overwrite").parquet(f"{quarantine}/version={version}")
    ingest_events(number_events(good), contexts, store, version, as_of, detector, ENVELOPES_PER_CHUNK << EVENT_BITS)
