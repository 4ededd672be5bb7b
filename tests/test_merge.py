"""Field rules of the merge, satellites and the keyed table."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.operators import merge
from feedloom.schemas import ARTICLES
from feedloom.session import scratch_path
from feedloom.sources.store import KeyedTable

T0, T1, NOW = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2025, 1, 1)
CANDIDATE = (
    "seq long, resolved_key string, is_root boolean, content_key string, published_at timestamp, canonical_url string, "
    "title string, summary string, image_url string, country string, language string, company_id long"
)
STORED = ("k", "c", T0, T0, "https://old", "Old", "Old summary", "https://img", "be", "en", 7)


def candidate(seq, key="k", root=True, content="c2", at=T1, url="https://new", title="New", summary=None, image=None,
              country="fr", language="fr", company=None):
    return (seq, key, root, content, at, url, title, summary, image, country, language, company)


def merged(spark, stored, rows):
    got = merge.merge_articles(
        spark.createDataFrame(stored, ARTICLES), spark.createDataFrame(rows, CANDIDATE), F.lit(NOW)
    ).collect()
    return {r.article_key: r for r in got}


def test_insert(spark):
    row = merged(spark, [], [candidate(1)])["k"]
    assert (row.language, row.country, row.ingested_at, row.title) == ("fr", "fr", NOW, "New")


@pytest.mark.parametrize("old, new, want", [("en", "fr", "en"), ("xx", "nl", "nl"), ("", "nl", "nl"), ("", "xx", "xx"), ("xx", "", "xx")])
def test_language(spark, old, new, want):
    stored = [STORED[:9] + (old,) + STORED[10:]]
    assert merged(spark, stored, [candidate(1, language=new)])["k"].language == want


def test_update_rules(spark):
    rows = [
        candidate(1, title="", summary="s1", country="", company=8),
        candidate(2, url="https://newer", title="Newer", country="xx", image="https://i2"),
        candidate(3, root=False, title="Ignored", country="de"),
    ]
    row = merged(spark, [STORED], rows)["k"]
    assert (row.content_key, row.published_at, row.ingested_at) == ("c", T0, T0)
    assert (row.canonical_url, row.title, row.summary) == ("https://newer", "Newer", "s1")
    # An unknown feed overwrites a known country.
    assert (row.country, row.company_id, row.image_url, row.language) == ("xx", 8, "https://i2", "en")


def test_untouched_rows_stay(spark):
    blank = ("z",) + STORED[1:8] + ("", "", None)
    rows = merged(spark, [STORED, blank], [candidate(1)])
    assert (rows["z"].country, rows["z"].language) == ("", "")
    changed = merge.changed_articles(
        spark.createDataFrame([STORED, blank], ARTICLES), spark.createDataFrame([candidate(1)], CANDIDATE), F.lit(NOW)
    )
    assert [r.article_key for r in changed.collect()] == ["k"]


def test_satellites(spark):
    rows = spark.createDataFrame(
        [
            (1, "k", ["Ada B", "Éva C"], 1, ["https://a/1?utm_a=1", "https://a/2"]),
            (2, "k", [], 2, ["https://a/2"]),
            (3, "m", ["ÉVA C"], 1, ["https://a/2", "x"]),
            (4, "k", ["ada b"], 1, []),
        ],
        "seq long, resolved_key string, authors array<string>, feed_id long, source_urls array<string>",
    )
    authors = {r.normalized_name: r.display_name for r in merge.author_dim(rows).collect()}
    assert authors == {"ada b": "Ada B", "eva c": "Éva C"}
    old = spark.createDataFrame([("ada b", "A. B."), ("x", "X")], "normalized_name string, display_name string")
    kept = {r.normalized_name: r.display_name for r in merge.author_dim(rows, old).collect()}
    assert kept == {"ada b": "A. B.", "eva c": "Éva C", "x": "X"}
    lists = merge.last_author_lists(rows)
    assert {r.article_key: r.authors for r in lists.collect()} == {"k": ["ada b"], "m": ["eva c"]}
    shown = merge.author_lists(merge.author_bridge(lists), merge.author_dim(rows))
    assert {r.article_key: r.authors for r in shown.collect()} == {"k": ["Ada B"], "m": ["Éva C"]}
    assert {r.url: r.article_key for r in merge.url_owners(rows).collect()} == {"https://a/1": "k", "https://a/2": "m"}
    links = merge.feed_links(rows, F.timestamp_seconds("seq")).select("article_key", "feed_id", F.unix_seconds("first_seen_at"))
    assert sorted(map(tuple, links.collect())) == [("k", 1, 1), ("k", 2, 2), ("m", 1, 3)]


def test_keyed_table(spark):
    table = KeyedTable(spark, scratch_path(spark, "table"), ["id"], "id long, v string")
    frame = lambda rows: spark.createDataFrame(rows, "id long, v string")
    shown = lambda v: sorted(map(tuple, table.read(v).collect()))
    assert shown(5) == []
    table.write_base(frame([(1, "a"), (2, "b")]))
    table.write(frame([(2, "c"), (3, "d")]), 1)
    table.write(frame([(3, None)]), 2)
    assert shown(0) == [(1, "a"), (2, "b")]
    assert shown(1) == [(1, "a"), (2, "c"), (3, "d")]
    assert shown(2) == [(1, "a"), (2, "c"), (3, None)]
    table.compact(2)
    table.write(frame([(1, "z")]), 3)
    table.write(frame([(1, "y")]), 3)
    assert shown(3) == [(1, "y"), (2, "c"), (3, None)]
    assert shown(1) == [(1, "a"), (2, "c"), (3, "d")]
