"""Resolution of many result sets against a walk from row to row."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.operators import merge
from feedloom.operators.resultsets import resolve_sets

START, AS_OF = datetime(2024, 1, 1), datetime(2025, 1, 1)
ROWS = "seq long, set_id long, article_key string, content_key string, published_at timestamp"
STORED = "article_key string, content_key string, published_at timestamp, ingested_at timestamp"


def walk(rows, stored):
    """``{seq: (article, is root)}`` and the articles afterwards; each set sees the articles that earlier sets left."""
    state = {k: (c, p, i) for k, c, p, i in stored}
    out, now, snapshot, by_key, by_content = {}, None, {}, {}, {}
    rank = lambda k: (snapshot[k][1] is not None, snapshot[k][1] or START, snapshot[k][2], k)
    for seq, set_id, key, content, published in sorted(rows):
        if set_id != now:
            now, snapshot, by_key, by_content = set_id, dict(state), {}, {}
        found = by_key.get(key) or (by_content.get(content) if content else None)
        root = found is None
        if root:
            same = [k for k, v in snapshot.items() if content and v[0] == content]
            found = key if key in snapshot else max(same, key=rank) if same else key
            c, p, i = state.get(found, (None, None, AS_OF))
            state[found] = (c if c is not None else content or None, p if p is not None else published, i)
            by_key[found] = found
        by_key[key] = found
        if content:
            by_content[content] = found
        out[seq] = (found, root)
    return out, state


def random_sets(worlds, rows, seed):
    """Small worlds side by side, each with few keys and contents, so that sets meet each other's articles all the time."""
    rng = random.Random(seed)
    moment = lambda: rng.choice([None, START + timedelta(rng.randrange(4))])
    said, stored = [], []
    for w in range(worlds):
        keys, contents = [f"{w}k{i}" for i in range(6)], [f"{w}c{i}" for i in range(3)]
        stored += [(k, rng.choice([*contents, None]), moment(), START + timedelta(rng.randrange(3))) for k in rng.sample(keys, rng.randrange(3))]
        said += [(rng.randrange(7), rng.choice(keys), rng.choice([*contents, None, ""]), moment()) for _ in range(rows)]
    rng.shuffle(said)
    said.sort(key=lambda r: r[0])
    return [(seq, *r) for seq, r in enumerate(said)], stored


def resolved(spark, rows, stored, **options):
    got = resolve_sets(spark.createDataFrame(rows, ROWS), spark.createDataFrame(stored, STORED), F.lit(AS_OF), **options)
    return {r.seq: (r.resolved_key, r.is_root) for r in got.collect()}


@pytest.mark.parametrize("seed, chunks", [(1, {"chunk_rows": 5, "chunk_sets": 2})])
def test_random_sets_in_one_job(spark, small_groups, seed, chunks):
    rows, stored = random_sets(400, 14, seed)
    want, _ = walk(rows, stored)
    got = resolved(spark, rows, stored, **chunks)
    wrong = {s: (got.get(s), w) for s, w in want.items() if got.get(s) != w}
    assert len(got) == len(rows) and not wrong, f"{len(wrong)} wrong, such as {list(wrong.items())[:3]}"


def test_split_into_jobs_gives_the_same_rows(spark):
    """Sets in two jobs, with the store carried from one to the next by the merge rules."""
    rows, stored = random_sets(60, 14, 5)
    want, _ = walk(rows, stored)
    state, got = stored, {}
    for part in ((0, 1, 2), (3, 4, 5, 6)):
        mine = [r for r in rows if r[1] in part]
        got |= resolved(spark, mine, state)
        _, after = walk(mine, state)
        state = [(k, *v) for k, v in after.items()]
    assert got == want


def test_a_content_in_every_set(spark):
    """A chain over forty sets: new keys, one content, publications that become known late."""
    rows = []
    for s in range(40):
        rows += [(3 * s, s, f"k{s}", "hot", None if s % 3 else START + timedelta(s)), (3 * s + 1, s, "k0", f"c{s}", None)]
        rows += [(3 * s + 2, s, f"k{s}", f"c{s + 1}", START)]
    want, _ = walk(rows, [("old", "hot", None, START)])
    assert resolved(spark, rows, [("old", "hot", None, START)]) == want


def test_no_rows(spark):
    assert resolved(spark, [], []) == {}
    assert resolved(spark, [(0, 0, "k", None, None)], []) == {0: ("k", True)}


def test_merge_of_sets_equals_merge_set_by_set(spark):
    """The fold of the whole batch leaves the articles that folds of the single sets leave."""
    rows, stored = random_sets(40, 14, 9)
    _, want = walk(rows, stored)
    empty = {c: F.lit(None).cast("string") for c in ("canonical_url", "title", "summary", "image_url", "country", "language")}
    empty["company_id"] = F.lit(None).cast("long")
    batch = spark.createDataFrame(rows, ROWS).withColumns(empty)
    articles = spark.createDataFrame(stored, STORED).withColumns(empty)
    merged = merge.merge_articles(articles, resolve_sets(batch, articles, F.lit(AS_OF)), F.lit(AS_OF))
    assert {r.article_key: (r.content_key, r.published_at, r.ingested_at) for r in merged.collect()} == want
