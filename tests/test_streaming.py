"""The whole path from JSON envelopes to the store, in one stream and in two."""

from __future__ import annotations

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.operators.candidates import feed_context
from feedloom.operators.ingest import FeedStore, ingest_envelopes
from feedloom.plans import QUERIES
from feedloom.plans import streams as plans
from feedloom.session import scratch_path
from feedloom.streaming import streams as S

AS_OF = datetime(2025, 1, 1)


def source(title, url, **more):
    return {"title": title, "summary": f"{title} body", "urls": [url], **more}


def envelope(number, events, version="1"):
    return {"envelope_id": number, "body": json.dumps({"contract_version": version, "result_events": events})}


def event(feed, sources, status="success", **more):
    return {"feed_id": feed, "job_id": "j", "status": status, "sources": sources, **more}


ENVELOPES = [
    envelope(1, [event(1, [source("One", "https://a.example/1?utm_x=1", author="By Ada B")], new_etag="e1"), event(2, [], "error", status_code=500)]),
    envelope(2, [event(1, [source("", "https://a.example/2")])]),
    {"envelope_id": 3, "body": '{"contract_version": "1", "result_ev'},
    envelope(4, [event(2, [source("ONE!", "https://a.example/copy", published_at=None)], "error", status_code=503)]),
    envelope(5, [event(1, [source("Deux", "https://b.example/fr/2", authors=["Zoé C", "Ada B"])])]),
]


def run(spark, parts, partitions=None):
    root = scratch_path(spark, "stream")
    inbox = f"{root}/in"
    os.makedirs(inbox)
    feeds = spark.createDataFrame([(1, "https://f.example", 1), (2, "https://g.example", 1)], "id long, url string, company_id long")
    companies = spark.createDataFrame([(1, "Co", "eu")], "id long, name string, country string")
    store = FeedStore.at(spark, f"{root}/store", partitions)
    for i, part in enumerate(parts):
        with open(f"{inbox}/{i}.json", "w") as out:
            out.writelines(json.dumps(row) + "\n" for row in part)
        raw = S.file_stream(spark, inbox, "envelope_id BIGINT, body STRING", "json")
        S.stream_ingest(raw, feed_context(feeds, companies), store, f"{root}/bad", F.lit(AS_OF), f"{root}/cp").awaitTermination()
    version = len(parts)
    show = lambda df, *cols: sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    return {
        "articles": show(store.articles.read(version), "article_key", "title", "language", "country", "canonical_url"),
        "authors": show(store.authors.read(version), "normalized_name", "display_name"),
        "lists": show(store.author_lists.read(version), "article_key", "authors"),
        "links": show(store.feed_links.read(version), "article_key", "feed_id"),
        "urls": show(store.urls.read(version), "url", "article_key"),
        "runtime": show(store.runtime.read(version), "feed_id", "last_status", "etag", "consecutive_error_count", "last_error_code"),
        "bad": show(spark.read.parquet(f"{root}/bad"), "envelope_id"),
    }


def test_stream_in_parts_equals_stream_at_once(spark):
    whole = run(spark, [ENVELOPES])
    # The copy of envelope 4 finds the article of envelope 1 in the store and updates its fields.
    assert [a[1] for a in sorted(whole["articles"], key=lambda a: a[4])] == ["ONE!", "Deux"]
    assert [a[2] for a in sorted(whole["articles"], key=lambda a: a[4])] == ["xx", "fr"]
    assert whole["bad"] == [("2",), ("3",)]
    assert whole["runtime"] == [("1", "success", "e1", "0", "None"), ("2", "error", "None", "2", "503")]
    assert [n for n, _ in whole["authors"]] == ["ada b", "zoe c"]
    assert len(whole["links"]) == 3 and len(whole["urls"]) == 3
    # In tables with partitions, and in two batches, the rows are the same.
    assert run(spark, [ENVELOPES[:3], ENVELOPES[3:]], partitions=4) == whole


def test_batch_equals_stream_and_survives_compaction(spark):
    whole = run(spark, [ENVELOPES])
    root = scratch_path(spark, "batch")
    store = FeedStore.at(spark, f"{root}/store")
    raw = spark.createDataFrame([(e["envelope_id"], e["body"]) for e in ENVELOPES], "envelope_id long, body string")
    feeds = spark.createDataFrame([(1, "https://f.example", 1), (2, "https://g.example", 1)], "id long, url string, company_id long")
    contexts = feed_context(feeds, spark.createDataFrame([(1, "Co", "eu")], "id long, name string, country string"))
    ingest_envelopes(raw, contexts, store, f"{root}/bad", 1, F.lit(AS_OF))
    # The same batch under the same version changes nothing; under the next one it is all known.
    ingest_envelopes(raw, contexts, store, f"{root}/bad", 1, F.lit(AS_OF))
    keys = lambda v: sorted(r.article_key for r in store.articles.read(v).collect())
    assert keys(1) == [a[0] for a in whole["articles"]]
    ingest_envelopes(raw, contexts, store, f"{root}/bad", 2, F.lit(AS_OF))
    before = sorted(map(str, store.articles.read(2).collect()))
    assert keys(2) == keys(1)
    store.compact(2)
    assert sorted(map(str, store.articles.read(2).collect())) == before
    runtime = {r.feed_id: r.consecutive_error_count for r in store.runtime.read(2).collect()}
    assert runtime == {1: 0, 2: 4}


@pytest.mark.parametrize("name", ["stream_feed_runtime", "stream_job_progress", "stream_dedup", "stream_rates", "stream_feed_silences"])
def test_streams_do_not_depend_on_files_or_batches(spark, tmp_path, monkeypatch, name):
    """A table of three part files read one file a batch gives the rows of the whole table."""
    source, parts = "/root/testdata/sf0.001", tmp_path / "parts"
    parts.mkdir()
    for other in os.listdir(source):
        if other not in ("events.parquet", "documents.parquet"):
            (parts / other).symlink_to(f"{source}/{other}")
    for table, key in (("events", "event_id"), ("documents", "doc_id")):
        folder = f"{parts}/{table}.parquet"
        spark.read.parquet(f"{source}/{table}.parquet").repartitionByRange(3, key).sortWithinPartitions(key).write.parquet(folder)
        for age, file in enumerate(sorted(os.listdir(folder))):  # files arrive in the order of events
            os.utime(f"{folder}/{file}", (1_700_000_000 + age, 1_700_000_000 + age))
    want = sorted(map(str, QUERIES[name](spark, source).collect()))
    monkeypatch.setitem(plans.OPTIONS, "maxFilesPerTrigger", "1")
    got = sorted(map(str, QUERIES[name](spark, str(parts)).collect()))
    assert want and got == want
