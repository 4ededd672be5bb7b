"""Entity resolution against a row-at-a-time walk, on many small random batches at once."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.operators.candidates import flag_duplicates
from feedloom.operators.resolve import resolve

START = datetime(2024, 1, 1)
STORED = "article_key string, content_key string, published_at timestamp, ingested_at timestamp"
ROWS = "seq long, article_key string, content_key string"


def walk(rows, stored):
    """Resolve in order with dictionaries; only for the small batches of this test."""
    by_key, by_content, out = {}, {}, {}
    own = {s[0] for s in stored}
    for seq, key, content in rows:
        found = by_key.get(key) or (by_content.get(content) if content else None)
        root = found is None
        if root:
            matches = [s for s in stored if content and s[1] == content]
            found = key if key in own else max(matches, key=lambda s: (s[2], s[3], s[0]))[0] if matches else key
            by_key[found] = found
        by_key[key] = found
        if content:
            by_content[content] = found
        out[seq] = (found, root)
    return out


def random_batches(count, size, seed, keys=4, contents=3):
    rng = random.Random(seed)
    rows, stored = [], []
    for b in range(count):
        names = [f"{b}k{i}" for i in range(keys)]
        texts = [f"{b}c{i}" for i in range(contents)]
        stored += [
            (k, rng.choice([*texts, None]), START + timedelta(rng.randrange(3)), START + timedelta(rng.randrange(3)))
            for k in rng.sample(names, rng.randrange(keys))
        ]
        rows += [(b * size + i, rng.choice(names), rng.choice([*texts, None, ""])) for i in range(rng.randrange(1, size))]
    return rows, stored


@pytest.mark.parametrize("seed, chunk_rows", [(1, 3), (2, 1000)])
def test_random_batches(spark, small_groups, seed, chunk_rows):
    rows, stored = random_batches(2500, 12, seed, keys=5, contents=4)
    want = walk(rows, stored)
    got = resolve(spark.createDataFrame(rows, ROWS), spark.createDataFrame(stored, STORED), chunk_rows)
    result = {r.seq: (r.resolved_key, r.is_root) for r in got.collect()}
    assert len(result) == len(rows)
    wrong = {s: (result[s], w) for s, w in want.items() if result[s] != w}
    assert not wrong, f"{len(wrong)} wrong, such as {list(wrong.items())[:3]}"


def test_hot_keys_and_long_chains(spark, small_groups):
    """One content holds a third of the rows, one key another; a chain hops between keys and contents."""
    rows = []
    for i in range(60):
        rows += [(3 * i, f"a{i}", "hot"), (3 * i + 1, "same", f"x{i}"), (3 * i + 2, f"z{i}", None)]
    n = len(rows)
    for i in range(40):
        # Each new key takes the content last used by a repeat of the key before it.
        rows += [(n + 2 * i, f"chain{i}", f"link{i}"), (n + 2 * i + 1, f"chain{i}", f"link{i + 1}")]
    stored = [("s", "hot", START, START), ("chain0", None, START, START)]
    want = walk(rows, stored)
    got = resolve(spark.createDataFrame(rows, ROWS), spark.createDataFrame(stored, STORED), chunk_rows=7)
    assert {r.seq: (r.resolved_key, r.is_root) for r in got.collect()} == want


@pytest.mark.parametrize(
    "rows, stored, want",
    [
        ([("k1", "c1"), ("k2", "c2"), ("k1", "c2"), ("k3", "c2")], [], ["k1", "k2", "k1", "k1"]),
        ([("k1", "c1"), ("k9", "c5")], [("k9", "c1", START, START)], ["k9", "k9"]),
        ([("k1", None), ("k2", None)], [], ["k1", "k2"]),
    ],
)
def test_traced_cases(spark, rows, stored, want):
    batch = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ROWS)
    got = resolve(batch, spark.createDataFrame(stored, STORED)).orderBy("seq").collect()
    assert [r.resolved_key for r in got] == want


def test_duplicate_hint(spark):
    rows, stored = random_batches(300, 9, 5)
    rows = [(s, k, c or None) for s, k, c in rows]
    keys, contents = {s[0] for s in stored}, {s[1] for s in stored if s[1]}
    want = {}
    for seq, key, content in rows:
        want[seq] = key in keys or (content is not None and content in contents)
        keys.add(key)
        contents.add(content)
    got = flag_duplicates(spark.createDataFrame(rows, ROWS), spark.createDataFrame(stored, STORED))
    assert {r.seq: r.duplicate_hint for r in got.select("seq", "duplicate_hint").collect()} == want
    assert got.select(F.count("*")).first()[0] == len(rows)
