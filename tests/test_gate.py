"""Gated ingest: sets are stored whole or not at all, and a redelivered report changes nothing."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from feedloom.operators.candidates import feed_context
from feedloom.operators.gate import TAKEN, ingest_gated
from feedloom.operators.ingest import FeedStore
from feedloom.session import scratch_path
from feedloom.sources.partitioned import PartitionedTable

AS_OF, AT = datetime(2025, 1, 1), datetime(2024, 6, 1)


def event(feed, title, job="j7", **more):
    return {"feed_id": feed, "job_id": job, "status": "success", "sources": [{"title": title, "urls": [f"https://a.example/{title}"]}], **more}


def body(*events):
    return json.dumps({"contract_version": "1", "result_events": events})


DELIVERED = [
    (1, 10, "a", AT, body(event(1, "one"), event(2, "two", status="error"))),
    (2, 10, "a", AT, body(event(1, "one"), event(2, "two", status="error"))),  # the same report again
    (3, 10, "b", AT, body(event(1, "other"), event(2, "set"))),
    (4, 11, "a", AT, body(event(1, "missing"))),
    (5, 12, "a", AT, body(event(1, "job", job="j8"), event(2, "x"))),
    (6, 13, "a", datetime(2024, 7, 1), body(event(1, "late"), event(2, "x"))),
    (7, 14, "a", AT, body(event(1, "broken", status="none"), event(2, "x"))),
    (8, 99, "a", AT, body(event(1, "stray"), event(2, "x"))),
    (9, 15, "a", AT, body(event(1, "nine"), event(2, "ten"))),
    (10, 16, "a", AT, body(event(1, "twice"), event(1, "twice"), event(2, "x"))),
]
WANT = {1: "stored", 2: "replay", 3: "conflict", 4: "incomplete", 5: "incomplete", 6: "expired", 7: "invalid", 8: "unknown_lease", 9: "stored", 10: "incomplete"}


def test_gate(spark):
    root = scratch_path(spark, "gate")
    store = FeedStore.at(spark, f"{root}/store", parts=4)
    taken = PartitionedTable(spark, f"{root}/taken", ["lease_id"], TAKEN, 4)
    contexts = feed_context(
        spark.createDataFrame([(1, "https://f.example", 1)], "id long, url string, company_id long"),
        spark.createDataFrame([(1, "Co", "eu")], "id long, name string, country string"),
    )
    leases = spark.createDataFrame([(i, 7, datetime(2024, 6, 2)) for i in range(10, 17)], "lease_id long, task_id long, expires_at timestamp")
    tasks = spark.createDataFrame([(7, "j7", [1, 2, 2])], "task_id long, job_id string, ref_ids array<long>")

    def deliver(rows, version):
        raw = spark.createDataFrame([(r[0], r[4]) for r in rows], "envelope_id long, body string")
        said = [(r[0], r[1], r[3], "completed", r[2], "h") for r in rows]
        schema = "envelope_id long, lease_id long, at timestamp, result_status string, result_nonce string, result_hash string"
        return ingest_gated(raw, spark.createDataFrame(said, schema), leases, tasks, contexts, store, taken, version, F.lit(AS_OF)).collect()

    def tables():
        parts = (store.articles, store.authors, store.author_lists, store.feed_links, store.urls, store.runtime, taken)
        return [sorted(map(str, t.read().collect())) for t in parts]

    first = deliver(DELIVERED, 1)
    assert {r.envelope_id: r.verdict for r in first} == WANT
    assert {r.envelope_id: (r.item_success, r.item_error) for r in first if r.verdict == "stored"} == {1: (1, 1), 9: (2, 0)}
    assert all((r.item_success, r.item_error) == (0, 0) for r in first if r.verdict != "stored")
    assert sorted(r.title for r in store.articles.read().collect()) == ["nine", "one", "ten", "two"]
    assert {r.lease_id for r in taken.read().collect()} == {10, 11, 12, 14, 15, 16}
    before = tables()
    again = deliver([(r[0] + 100, *r[1:]) for r in DELIVERED], 2)
    verdicts = {r.envelope_id - 100: r.verdict for r in again}
    assert verdicts == {**dict.fromkeys(WANT, "replay"), 3: "conflict", 6: "expired", 8: "unknown_lease"}
    assert tables() == before
