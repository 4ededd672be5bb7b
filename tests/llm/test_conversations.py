"""Quote linking and co-training."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from feedloom.llm import cotrain, quotes

SCHEMA = "conv_id long, turn long, role string, text string, passage long, level int"


def brute_links(messages):
    """Sequential walk; messages: (conv, turn) -> text."""

    def split(text):
        own, said = [], []
        lines = re.split("\r?\n", text or "")
        depth = [re.match(r"((?: ?>)+)", x) for x in lines]
        depth = [m[1].count(">") if m else 0 for m in depth]
        norm = [re.sub(r"\s+", " ", re.sub(r"^(?: ?>)+", "", x).lower()).strip(" ") for x in lines]
        for i, line in enumerate(lines):
            if depth[i]:
                if norm[i]:
                    said.append((depth[i], norm[i]))
            elif not (re.match(r"(?i)\s*on .{1,200} wrote:\s*$", line) and i + 1 < len(lines) and depth[i + 1]):
                own.append((line, norm[i]))
        return own, said

    out = {}
    for (conv, turn), text in messages.items():
        own, said = split(text)
        votes, linked = Counter(), 0
        for depth, passage in said:
            before = [t for (c, t), x in messages.items() if c == conv and t < turn and passage in [n for _, n in split(x)[0]]]
            if before:
                linked += 1
                votes[max(before)] += depth == 1
        best = max(((n, t) for t, n in votes.items() if n), default=None)
        previous = max((t for c, t in messages if c == conv and t < turn), default=None)
        out[conv, turn] = [best[1] if best else previous, max([d for d, _ in said], default=0), len(said), linked, "\n".join(x for x, _ in own), best]
    links = {key: (key[0], row[0]) for key, row in out.items() if row[5]}
    for key, row in out.items():
        depth, at = 0, key
        while at in links:
            depth, at = depth + 1, links[at]
        row[5] = (at[1], depth)
    return out


@pytest.fixture(scope="module")
def talk():
    draw = random.Random(3)
    messages = {}
    for conv in range(4):
        for turn in range(30 if conv else 700):
            lines = [f"Line {draw.randrange(40)} of Text" for _ in range(draw.randrange(3))]
            if turn and draw.random() < 0.6:
                source = messages[conv, draw.randrange(max(0, turn - 300), turn)].split("\n")
                lines = ["On Monday, A. wrote:", *(f">{' ' if x[:1] != '>' else ''}{x.upper()}" for x in source[:4]), *lines]
            messages[conv, turn] = "\n".join(lines)
    messages[9, 0], messages[9, 5], messages[9, 7] = "", None, "> > never said\r\n>\n > Line 1\nOn it he wrote:\nend"
    return messages


def test_quotes_against_a_sequential_walk(spark, talk, monkeypatch):
    monkeypatch.setattr(quotes, "CHUNK_TURNS", 64)
    rows = [(c, t, "user", x, 1, 2) for (c, t), x in talk.items()]
    got = quotes.link_quotes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute_links(talk)
    assert len(got) == len(want)
    for r in got:
        assert [r.parent_turn, r.n_levels, r.n_quoted, r.n_linked, r.text, (r.thread_turn, r.depth)] == want[r.conv_id, r.turn], (r, talk[r.conv_id, r.turn])


def test_odd_messages(spark):
    rows = [(None, 1, "user", "> hi", 0, 0), (1, None, "user", "hi", 0, 0), (1, 0, "user", "hi", 0, 0), (1, 0, "user", "hi", 0, 0), (1, 1, None, "> HI\nyes", 0, 0)]
    got = sorted((tuple(r) for r in quotes.link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert sorted(((r[0], r[2], r[5], r[8], r[9]) for r in got), key=str) == sorted(
        [(None, 1, None, 0, ""), (1, None, None, 0, "hi"), (1, 0, None, 0, "hi"), (1, 0, None, 0, "hi"), (1, 1, 0, 1, "yes")], key=str)
    assert quotes.link_quotes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_registered_conversations_keep_every_message(spark):
    from feedloom.llm.queries import QUERIES

    rows = QUERIES["op2_quote_linking"](spark, "/root/testdata/sf0.001").collect()
    replies = [r for r in rows if r.turn > 0]
    assert sum(r.n_linked > 0 and r.depth > 0 for r in replies) > 0.9 * len(replies) and {r.n_levels for r in replies} == {1, 2, 3}
    want = {(r.conv_id, r.turn): r.text for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()}
    assert {(r.conv_id, r.turn): r.text for r in rows} == want


def test_quoting_replies_link_as_the_walk_says(spark):
    rows = [(c, t, "user", f"Line {t % 5} of {c}\n\nEnd {t}", 1, 2) for c in range(3) for t in range(12)]
    rows += [(0, 3, "user", "Again", 0, 0), (0, 13, "user", None, 0, 0), (None, 1, "user", "x", 0, 0), (5, None, "user", "y", 0, 0)]
    told = quotes.quoting_replies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(told) == len(rows) and all(r.text == "x" for r in told if r.conv_id is None)
    (text,) = [r.text for r in told if (r.conv_id, r.turn) == (1, 10)]  # quotes the turns 8 and 7
    assert text == "On turn 7, A. wrote:\n> >  Line 2 of 1\n> >  \n> >  End 7\nOn turn 8, A. wrote:\n>  Line 3 of 1\n>  \n>  End 8\nLine 0 of 1\n\nEnd 10"
    one = {(r.conv_id, r.turn): r.text for r in told if r.conv_id in (1, 2)}
    got = quotes.link_quotes(spark.createDataFrame([(c, t, "user", x, 1, 2) for (c, t), x in one.items()], SCHEMA)).collect()
    want = brute_links(one)
    for r in got:
        assert [r.parent_turn, r.n_levels, r.n_quoted, r.n_linked, r.text, (r.thread_turn, r.depth)] == want[r.conv_id, r.turn]
    assert quotes.quoting_replies(spark.createDataFrame([], SCHEMA)).collect() == []


# Co-training


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_held_out_quality(spark, labelled):
    docs, labels = labelled
    learn, rest = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = cotrain.score_quality(docs, learn, rounds=1)
    rows = got.join(rest, "doc_id").collect()
    assert got.count() == docs.count() and rows
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.good for r in good) >= 0.95 * len(good) and sum(not r.good for r in bad) >= 0.8 * len(bad)
    assert all(0 <= x <= 1 for r in rows for x in (r.content_score, r.meta_score, r.score))


def test_without_both_classes_scores_are_even(odd_rows, labelled):
    got = cotrain.score_quality(odd_rows, labelled[1].where("quality = 1")).collect()
    assert len(got) == odd_rows.count() and {r.score for r in got} == {0.5}


def test_odd_documents_get_scores(spark, labelled, odd_rows, no_rows):
    docs, labels = labelled
    odd = docs.limit(300).unionByName(odd_rows.select(docs.columns))
    messy = labels.unionByName(labels.where("doc_id < 50")).unionByName(spark.createDataFrame([(3, None, None), (None, 1, 0)], labels.schema))
    got = cotrain.score_quality(odd, messy, rounds=1).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert cotrain.score_quality(no_rows, labels).collect() == []
