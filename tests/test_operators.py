"""Feeds, jobs, workers and quality on small fixtures, with groups cut and keys salted."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.functions.language import detection_text
from feedloom.operators import feeds, jobs, language, quality, skew, workers
from feedloom.sources import results as results_source

T = datetime(2024, 1, 1)
RESULT = (
    "feed_id long, seq long, at timestamp, status string, status_code int, etag string, feed_update timestamp, article_at timestamp"
)


def results(spark, statuses, feed=1):
    rows = [
        (feed, i, T + timedelta(hours=i), s[0], s[1] if len(s) > 1 else None, s[2] if len(s) > 2 else None, None,
         T + timedelta(hours=s[3]) if len(s) > 3 else None)
        for i, s in enumerate(statuses)
    ]
    return spark.createDataFrame(rows, RESULT)


@pytest.mark.parametrize("chunk_rows", [1, 2, 100])
@pytest.mark.parametrize(
    "statuses, streak, code, etag",
    [
        ([("error", 500), ("error", 503)], 2, 503, None),
        ([("error", 500), ("not_modified",)], 0, None, None),
        ([("success", None, "a"), ("error", 500)], 1, 500, "a"),
        ([("ok",), ("error", 1), ("ok",), ("error", 2), ("error", 3), ("error", 4)], 3, 4, None),
    ],
)
def test_feed_streaks(spark, statuses, streak, code, etag, chunk_rows):
    row = feeds.feed_runtime(results(spark, statuses), chunk_rows=chunk_rows).first()
    assert (row.consecutive_error_count, row.last_error_code, row.etag) == (streak, code, etag)
    assert (row.last_error_at is None) == (code is None)


def test_feed_runtime_goes_on_from_the_state_before(spark):
    """Feeding the results in two parts gives the same rows as feeding them at once."""
    rng = random.Random(3)
    rows = [
        (rng.randrange(6), i, T + timedelta(minutes=i), rng.choice(["error", "error", "ok"]), i, rng.choice(["e", None]),
         None, rng.choice([T, None]))
        for i in range(200)
    ]
    whole = feeds.feed_runtime(spark.createDataFrame(rows, RESULT), chunk_rows=16)
    first = feeds.feed_runtime(spark.createDataFrame(rows[:20], RESULT), chunk_rows=16)
    second = feeds.feed_runtime(spark.createDataFrame(rows[20:], RESULT), first, chunk_rows=16)
    assert sorted(map(tuple, second.collect())) == sorted(map(tuple, whole.collect()))


def test_last_article_time_may_go_back(spark):
    row = feeds.feed_runtime(results(spark, [("success", None, None, 10), ("success", None, None, 9)])).first()
    assert (row.consecutive_error_count, row.last_article_published_at) == (0, T + timedelta(hours=9))


@pytest.mark.parametrize(
    "counts, want",
    [
        ((0, 0, 0, 0, 0, 0), "completed"), ((0, 0, 0, 1, 4, 0), "processing"), ((2, 0, 0, 0, 3, 0), "processing"),
        ((0, 0, 0, 0, 5, 0), "queued"), ((4, 0, 1, 0, 0, 2), "cancelled"), ((4, 1, 0, 0, 0, 3), "completed_with_errors"),
        ((4, 1, 0, 0, 0, 0), "completed"),
    ],
)
def test_job_status(spark, counts, want):
    statuses = ["completed", "failed", "cancelled", "processing", "pending"]
    tasks = [(i, "j", s, 1, 0) for s, n in zip(statuses, counts) for i in range(n)]
    tasks = [t[:4] + (counts[5] if i == 0 else None,) for i, t in enumerate(tasks)]
    frame = spark.createDataFrame(tasks, "task_id long, job_id string, status string, item_success long, item_error long")
    job = spark.createDataFrame([("j",)], "job_id string")
    assert jobs.job_status(job, frame).first().status == want


@pytest.mark.parametrize("chunk_rows", [1, 3, 100])
def test_lifecycle(spark, chunk_rows):
    changes = ["queued", "processing", "completed", "queued", "failed", "failed", "completed"]
    frame = spark.createDataFrame([("j", i, T + timedelta(days=i), s) for i, s in enumerate(changes)], "job_id string, seq long, at timestamp, status string")
    row = jobs.job_lifecycle(frame, chunk_rows).first()
    assert (row.status, row.started_at, row.finished_at) == ("completed", T + timedelta(1), T + timedelta(4))
    row = jobs.job_lifecycle(frame.where("seq < 4"), chunk_rows).first()
    assert (row.status, row.started_at, row.finished_at) == ("queued", T + timedelta(1), None)


@pytest.mark.parametrize("chunk_rows", [1, 4, 1000])
def test_attempts(spark, chunk_rows):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 2, 3])) for i in range(100)]
    got = jobs.task_attempts(spark.createDataFrame(rows, "seq long, task_id long"), chunk_rows).orderBy("seq").collect()
    seen: dict[int, int] = {}
    for row in got:
        seen[row.task_id] = seen.get(row.task_id, 0) + 1
        assert row.attempt_count == seen[row.task_id]


def test_ledger(spark, small_groups):
    rows = [
        ("a", 1, "completed", "n1"), ("a", 30, "completed", "n1"), ("a", 31, "failed", "n1"), ("a", 2, "completed", "n2"),
        ("b", 20, "completed", "n1"), ("b", 21, "completed", "n1"), ("c", 1, "completed", "n1"),
    ]
    frame = spark.createDataFrame(
        [(i, lease, T + timedelta(hours=h), s, n, "h") for i, (lease, h, s, n) in enumerate(rows)],
        "seq long, lease_id string, at timestamp, result_status string, result_nonce string, result_hash string",
    )
    leases = spark.createDataFrame([(x, T + timedelta(hours=20)) for x in "ab"], "lease_id string, expires_at timestamp")
    got = workers.lease_ledger(frame, leases).orderBy("seq").collect()
    assert [r.verdict for r in got] == ["accepted", "replay", "conflict", "conflict", "expired", "expired", "unknown_lease"]


def test_salted_join_keeps_every_row(spark, small_groups):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "id long, key string")
    lookup = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 300, 6)]], "key string, v long")
    joined = skew.salted_join(rows, lookup, "key", spread=["id"])
    plain = rows.join(lookup, "key", "left").select(joined.columns)
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))
    assert skew.hot_keys(rows, "key") == {"hot": 68}
    inner = skew.salted_join(rows, lookup, "key", spread=["id"], how="inner")
    assert inner.count() == rows.join(lookup, "key").count()


def test_backlog_limits_before_the_exchange(spark):
    tasks = spark.createDataFrame(
        [(i, i % 3, "rss.fetch" if i % 2 else "embed.source", "pending", None, T + timedelta(minutes=-i), None) for i in range(50)],
        "task_id long, job_id long, task_type string, status string, claim_expires_at timestamp, requested_at timestamp, worker_version string",
    )
    open_jobs = spark.createDataFrame([(0, "queued"), (1, "processing"), (2, "completed")], "job_id long, status string")
    got = workers.claimable_backlog(tasks, open_jobs, 3, F.lit(T), worker_version="")
    assert sorted((r.task_type, r.rank, r.task_id) for r in got.collect()) == [
        ("embed.source", 1, 48), ("embed.source", 2, 46), ("embed.source", 3, 42),
        ("rss.fetch", 1, 49), ("rss.fetch", 2, 45), ("rss.fetch", 3, 43),
    ]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_usage_goes_on(spark):
    uses = spark.createDataFrame(
        [(1, "w", 1, T, "a", "v1"), (1, "w", 2, T + timedelta(1), "b", None)],
        "api_key_id long, worker_name string, seq long, at timestamp, worker_type string, worker_version string",
    )
    first = workers.worker_usage(uses)
    row = workers.worker_usage(uses.where("seq = 1"), first).first()
    assert (row.worker_type, row.worker_version, row.last_seen_at, row.use_count) == ("a", "v1", T, 3)


def test_completeness(spark):
    tasks = spark.createDataFrame(
        [(i, "j", [1, 2, 2, 0]) for i in range(1, 6)] + [(6, "j", [0]), (7, "j", None)], "task_id long, job_id string, ref_ids array<long>"
    )
    seen = {1: [1, 2], 2: [1], 3: [1, 2, 3], 4: [1, 1, 2], 5: [1, 2]}
    events = [(t, "other" if t == 5 and f == 2 else "j", f) for t, fs in seen.items() for f in fs]
    got = quality.completeness_violations(tasks, spark.createDataFrame(events, "task_id long, job_id string, feed_id long"))
    assert sorted((r.task_id, r.rule, r.feed_id, r.n) for r in got.collect()) == [
        (2, "missing", 2, 0), (3, "unexpected", 3, 1), (4, "duplicate", 1, 2), (5, "wrong_job", None, 1),
        (6, "no_refs", None, 0), (7, "no_refs", None, 0),
    ]


def test_backfill(spark):
    rows = [
        (1, "Bundestag stimmt ab", "Berlin", "eu", None, "xx"), (2, "", None, "be", None, "xx"), (3, "Already set", None, "us", None, "en"),
    ]
    articles = spark.createDataFrame(rows, "id long, title string, summary string, country string, canonical_url string, language string")
    detect = lambda df: df.withColumn("label", F.when(F.col("text").contains("Bundestag"), "__label__de"))
    filled = language.backfill_language(articles, detect, key="id")
    assert [r.language for r in filled.orderBy("id").collect()] == ["de", "xx", "en"]
    assert tuple(language.backfill_metrics(filled, key="id").first()) == (2, 1, 2)
    batch = language.backfill_language(articles, detect, start_after=1, limit=5, key="id")
    assert [r.language for r in batch.orderBy("id").collect()] == ["xx", "xx", "en"]
    assert tuple(language.backfill_metrics(batch, key="id").first()) == (1, 0, 2)


def test_predictor_detector(spark):
    class Predictor:
        def predict(self, text, k=1):
            assert "\n" not in text and k == 1
            if "broken" in text:
                raise ValueError(text)
            return (["__label__DE"], [0.9]) if "Bundestag" in text else ([], [])

    rows = [(1, "Bundestag\n\nstimmt", None), (2, "broken", None), (3, "other", None), (4, "Bundestag", "fr"), (5, "", None)]
    text = detection_text(F.col("title"), F.lit(" ")).alias("text")
    frame = spark.createDataFrame(rows, "id long, title string, declared string").select("id", "declared", text)
    got = language.assign_language(frame, language.predictor_detector(Predictor)).orderBy("id").collect()
    assert [r.language for r in got] == ["de", "xx", "xx", "fr", "xx"]

    def unavailable():
        raise OSError("no model")

    got = language.assign_language(frame, language.predictor_detector(unavailable)).orderBy("id").collect()
    assert [r.language for r in got] == ["xx", "xx", "xx", "fr", "xx"]


def test_envelopes_from_files(spark, tmp_path):
    good = {"contract_version": "1", "result_events": [{"feed_id": 1, "job_id": "j", "status": "ok", "sources": []}]}
    late = {"contract_version": "1", "result_events": [{"feed_id": 0, "job_id": "j", "status": "done", "new_etag": None}]}
    bodies = [json.dumps(good), json.dumps(late), "{", json.dumps({"contract_version": ""}), '{"contract_version": "1"}']
    lines = [json.dumps({"envelope_id": i, "body": b}) for i, b in enumerate(bodies)]
    (tmp_path / "a.json").write_text("\n".join(lines))
    parsed = results_source.read_results(spark, str(tmp_path))
    accepted, rejected = quality.split_valid(parsed)
    assert sorted(r.envelope_id for r in accepted.collect()) == [0, 4]
    assert sorted(r.envelope_id for r in rejected.collect()) == [1, 2, 3]
    found = quality.contract_violations(parsed).collect()
    assert sorted((r.envelope_id, r.rule) for r in found) == [
        (1, "feed_id"), (1, "status"), (2, "contract_version"), (2, "parse"), (3, "contract_version"),
    ]
    events = results_source.result_events(accepted).collect()
    assert [(r.envelope_id, r.event_pos, r.feed_id) for r in events] == [(0, 0, 1)]


def test_json_types_are_checked(spark):
    def body(source=None, event=None, **envelope):
        one = {"title": "t", "summary": None, "urls": ["https://a.example/1"], "authors": ["x"]} | (source or {})
        item = {"feed_id": 1, "job_id": "j", "status": "ok", "status_code": 200, "sources": [one]} | (event or {})
        return json.dumps({"contract_version": "1", "result_events": [item]} | envelope)

    cases = [
        (body(), set()), (body(event={"feed_id": "5", "status_code": "304"}), set()), (body(event={"feed_id": 5.0}), set()),
        (body(event={"status_code": None, "new_etag": None}), set()),
        (body(source={"title": 5}), {"title"}), (body(source={"summary": {"a": 1}}), {"summary"}),
        (body(source={"authors": None}), {"authors"}), (body(source={"authors": [1]}), {"authors"}),
        (body(source={"urls": [7]}), {"url"}), (body(event={"job_id": 7}), {"job_id"}),
        (body(event={"feed_id": 1.5}), {"feed_id"}), (body(event={"feed_id": True}), {"feed_id"}),
        (body(event={"status_code": "x"}), {"status_code"}), (body(event={"status_code": False}), {"status_code"}),
        (body(event={"sources": None}), {"sources"}), (body(contract_version=1), {"contract_version"}),
        (body(result_events=None), {"result_events"}), (body() + " more", {"parse"}), (body() + "," + body(), {"parse"}),
        (None, {"parse", "contract_version"}), ("", {"parse", "contract_version"}),
    ]
    raw = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "envelope_id long, body string")
    parsed = results_source.parse_results(raw)
    got = {i: set() for i in range(len(cases))}
    for row in quality.contract_violations(parsed).collect():
        got[row.envelope_id].add(row.rule)
    assert got == {i: rules for i, (_, rules) in enumerate(cases)}
    accepted = quality.split_valid(parsed)[0]
    assert {r.feed_id for r in results_source.result_events(accepted).collect()} == {1, 5}
