"""Silences of feeds, in batch and on a stream."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from feedloom.operators.feeds import feed_silences
from feedloom.session import scratch_path
from feedloom.sources.store import KeyedTable
from feedloom.streaming import streams as S

START, HOUR = datetime(2024, 1, 1), timedelta(hours=1)
SCHEMA = "feed_id long, at timestamp_ntz, status string"


def brute(rows, hours, as_of):
    out, feeds = [], {}
    for feed, at, status in sorted((r for r in rows if r[1] is not None and r[1] <= as_of), key=lambda r: r[1]):
        feeds.setdefault(feed, []).append((at, status))
    for feed, said in feeds.items():
        spell = []
        for row, following in zip(said, [*said[1:], None], strict=True):
            spell.append(row)
            if following is None or following[0] > row[0] + hours * HOUR:
                if row[0] + hours * HOUR <= as_of:
                    out.append((feed, spell[0][0], row[0], row[0] + hours * HOUR, len(spell), sum(s == "error" for _, s in spell)))
                spell = []
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("feed_id", "active_from", "last_result_at", "silent_at", "results", "errors").collect()), key=str)


def test_batch_against_a_walk(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), START + timedelta(minutes=rng.randrange(60 * 24 * 9)), rng.choice(["error", "success"])) for _ in range(150)]
    # Exactly as long as allowed, a moment longer, copies, and a result without a time.
    rows += [(9, START, "error"), (9, START + 5 * HOUR, "x"), (9, START + 10 * HOUR + timedelta(microseconds=1), None), (9, START, "error"), (8, None, "x")]
    as_of = START + timedelta(days=7)
    got = rows_of(feed_silences(spark.createDataFrame(rows, SCHEMA).repartition(5), 5, F.lit(as_of).cast("timestamp_ntz")))
    assert got == brute(rows, 5, as_of)
    assert len([r for r in got if r[0] == 9]) == 2
    assert rows_of(feed_silences(spark.createDataFrame([], SCHEMA), 5, F.lit(as_of).cast("timestamp_ntz"))) == []


def stream(spark, parts, hours=5, delay="2 hours"):
    root = scratch_path(spark, "silences")
    os.makedirs(f"{root}/in")
    table = KeyedTable(spark, f"{root}/table", ["feed_id", "silent_at"], S.SILENCES)
    held = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(f"{root}/in/{i}")
        rows = S.file_stream(spark, f"{root}/in/*", "feed_id long, at timestamp, status string")
        query = S.stream_silences(rows, table, f"{root}/checkpoint", hours, delay)
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return rows_of(table.read()), held


def test_stream_in_any_split_equals_a_walk_and_holds_open_sessions_only(spark):
    rng = random.Random(6)
    # Results of a hot feed and of others, up to two hours out of order.
    times = sorted(START + timedelta(minutes=rng.randrange(60 * 24 * 6)) for _ in range(400))
    rows = [(rng.choice([1, 1, 2, 3, 4]) if m.hour % 12 < 6 else 5, m, rng.choice(["error", "success"])) for m in times]
    rows += [(7, START, "success"), (7, START + 5 * HOUR, "success"), (7, START + 10 * HOUR + timedelta(microseconds=1), "error")]
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rng.randrange(119)))
    # Told are the silences the watermark has passed, though later results were seen.
    want = [r for r in brute(rows, 5, datetime(2030, 1, 1)) if r[3] <= max(x[1] for x in rows) - 2 * HOUR]
    whole, held = stream(spark, [rows])
    assert whole == want and len(want) > 20
    parts, held = stream(spark, [rows[:100], rows[100:101], rows[101:300], rows[300:]])
    assert parts == want
    assert max(held) <= 20  # a few sessions per feed, never their results


def test_results_behind_the_watermark_are_left_out(spark):
    early = [(1, START, "success"), (2, START + 20 * HOUR, "success")]
    got, _ = stream(spark, [early, [(1, START + HOUR, "error")], [(2, START + 40 * HOUR, "success")]])
    assert got == [
        (1, START, START, START + 5 * HOUR, 1, 0),
        (2, START + 20 * HOUR, START + 20 * HOUR, START + 25 * HOUR, 1, 0),
    ]
