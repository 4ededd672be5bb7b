"""The operators against brute force on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from feedloom.llm import chosenpath, langid, lzprint, mixing, tokens
from feedloom.llm.queries import tokenizer_path


def rows_of(df):
    return df.collect()


# Language identification


def test_language_is_learned_from_the_rest_and_found_in_the_held_out_fifth(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_id(docs).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_prediction_does_not_see_language_source_or_id(spark, mixed):
    prototypes = langid.train(mixed)
    plain = {r.text: r.lang_pred for r in langid.predict(mixed.select("text"), prototypes).collect()}
    full = langid.predict(mixed, prototypes)
    assert full.columns == [*mixed.columns, "lang_pred", "score"]
    assert {r.text: r.lang_pred for r in full.collect()} == plain


def test_texts_without_letters_are_unknown(odd_rows):
    got = langid.predict(odd_rows, langid.train(odd_rows)).collect()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert {r.lang_pred for r in got if r.doc_id in (7, 11)} == {"de"}
    assert sum(r.doc_id == 3 for r in got) == 2


def test_bundle_equals_its_definition():
    text, short = "Ab c1ab, Äb", "x"
    got = langid.bundle([langid.letters(t) for t in (text, short)], [0, 1], 2)
    for line, t in enumerate((text, short)):
        codes = [ord(c) if c.isalpha() else 0 for c in re.sub(r"[^a-zä]+", " ", f" {t.lower()} ")]
        want = sum(np.roll(langid._vector(a), 2) * np.roll(langid._vector(b), 1) * langid._vector(c).astype(int)
                   for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
        assert (got[line] == want).all()


def test_a_long_text_is_the_sum_of_its_blocks(monkeypatch):
    codes = langid.letters("ein langer Text über Blöcke hinweg " * 50)
    whole = langid.bundle([codes], [0], 1)
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert (langid.bundle([codes], [0], 1) == whole).all()


def test_empty_table_has_no_languages(no_rows):
    assert langid.train(no_rows) == {}
    assert rows_of(langid.language_id(no_rows)) == []


# Phrase fingerprints


def phrases(text):
    found, open_ = set(), ""
    for symbol in lzprint._SYMBOL.findall(text):
        open_ += symbol
        if open_ not in found:
            found.add(open_)
            open_ = ""
    return found


def print_of(text):
    import xxhash

    return np.unique(np.array([xxhash.xxh3_64_intdigest(p) >> 32 for p in phrases(text)], np.uint32))[: lzprint.SKETCH]


def test_fingerprints_against_a_sequential_walk(mixed):
    got = {(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint): r for r in lzprint.fingerprints(mixed).collect()}
    order = sorted(((r.doc_id if r.doc_id is not None else -(1 << 63), r.text or "") for r in mixed.collect()))
    want = []
    for i, (doc_id, text) in enumerate(order):
        following, n = order[(i + 1) % len(order)][1], len(text)
        edited = text[: n - n // 4] + following[: n // 4]
        a, b, c = print_of(text), print_of(edited), print_of(following)
        want.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), lzprint._hex(a), lzprint._hex(b), lzprint.likeness(a, b), lzprint.likeness(a, c)))
    rows = [(-(1 << 63) if r.doc_id is None else r.doc_id, *r[1:]) for r in lzprint.fingerprints(mixed).collect()]
    assert sorted(rows) == sorted(want)
    assert len(got) >= 200


def test_edited_texts_are_parsed_on_exactly():
    text = "one two three one two four one two three five 六七八 one two " * 3
    for cut in range(0, len(text), 5):
        new, got = lzprint.TextPrint(text).edited("one two six", cut)
        assert got.tolist() == lzprint.fingerprint(new).tolist() == print_of(new).tolist()


def test_a_very_long_text_is_parsed_by_one_dictionary():
    text = "".join(f" w{i * i % 997}" for i in range(1_200_000))
    own = lzprint.TextPrint(text)
    assert own.sketch.tolist() == print_of(text).tolist()
    new, got = own.edited("x" * 1000, len(text) - 1000)
    assert got.tolist() == print_of(new).tolist()


def test_likeness_of_small_sets_is_exact():
    a, b = np.array([1, 2, 3], np.uint32), np.array([2, 3, 4], np.uint32)
    assert lzprint.likeness(a, b) == 0.5
    assert lzprint.likeness(a[:0], b[:0]) == 1 and lzprint.likeness(a, b[:0]) == 0


def test_lone_document_follows_itself(spark, no_rows):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    (row,) = lzprint.fingerprints(one).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1
    assert rows_of(lzprint.fingerprints(no_rows)) == []


# Token counts


def test_token_counts_are_the_librarys(mixed):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    got = tokens.count_tokens(mixed, tokenizer_path())
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in mixed.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got.collect()) == want


def test_frequent_tokens_only_route(mixed, monkeypatch):
    want = sorted(tokens.count_tokens(mixed, tokenizer_path()).collect(), key=str)
    monkeypatch.setattr(tokens, "frequent_pieces", lambda *_: {})
    assert sorted(tokens.count_tokens(mixed, tokenizer_path()).collect(), key=str) == want


def test_no_documents_have_no_tokens(no_rows):
    assert rows_of(tokens.count_tokens(no_rows, tokenizer_path())) == []


# Mixing


def targets(sizes):
    """Water filling by the book; sizes: source -> words."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        share = {s: 3 * sizes[s] if s in full else rest * weight[s] / open_ for s in order}
        above = {s for s in order if s not in full and share[s] > 3 * sizes[s]}
        if not above:
            return share
        full |= above


def test_mix_meets_targets(mixed):
    got = mixing.mix_sources(mixed).collect()
    source = {(r.doc_id, len(re.findall(r"[^ \t-\r]+", r.text or ""))): r.source for r in mixed.collect()}
    sizes, taken, largest = Counter(), Counter(), defaultdict(int)
    for r in got:
        s = source[r.doc_id, r.size]
        sizes[s] += r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = targets(sizes)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert len(got) == mixed.count()
    assert sorted(got, key=str) == sorted(mixing.mix_sources(mixed.repartition(7)).collect(), key=str)


def test_reduction_tree_leaves_one_open_row(mixed, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 4)
    rows = mixing.mix_sources(mixed).join(mixed.select("doc_id", "source"), "doc_id").where("doc_id < 1000").collect()
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        x = by[r.source]
        x[0], x[1], x[2] = x[0] + r.taken, r.target, max(x[2], r.size)
    assert all(abs(t - want) <= 2 * most + 20 for t, want, most in by.values())


def test_trade_keeps_words_and_is_fair():
    size, total = np.array([5.0, 3.0, 8.0, 1.0]), np.zeros(4)
    for seed in range(4000):
        p = np.array([0.3, 0.6, 0.5, 0.25])
        mixing._trade(size, p, np.random.default_rng(seed))
        assert abs((size * p).sum() - 7.55) < 1e-6 and ((p > 0) & (p < 1)).sum() <= 1
        total += p
    assert np.abs(total / 4000 - [0.3, 0.6, 0.5, 0.25]).max() < 0.03


def test_nothing_to_mix(no_rows):
    assert rows_of(mixing.mix_sources(no_rows)) == []


# Near duplicates


def brute_components(rows, percent):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(rb"[^ \t-\r]+", (text or "").encode().lower())
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.fixture(scope="module")
def chains(spark, mixed):
    """Documents, odd rows, a chain of gradual edits, and a group of near copies around one text."""
    words = [f"w{i}" for i in range(120)]
    extra = [(5000 + k, " ".join([f"x{k}_{j}" for j in range(2 * k)] + words[2 * k :])) for k in range(20)]
    for k in range(60):
        own = list(words)
        own[(7 * k) % 118] = f"edit{k}"
        extra.append((6000 + k, " ".join(own).upper() if k % 2 else " ".join(own)))
    extra += [(7000 + k, f"Same words here {k % 2}") for k in range(6)]
    return mixed.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).where("doc_id is not null")


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_against_all_pairs(chains, percent):
    got = {r.doc_id: tuple(r[1:]) for r in chosenpath.near_duplicates(chains, percent).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in chains.collect()], percent)


def test_large_nodes_are_still_whole(chains, monkeypatch):
    monkeypatch.setattr(chosenpath, "SMALL", 2)
    monkeypatch.setattr(chosenpath, "BLOCK", 16)
    got = {r.doc_id: tuple(r[1:]) for r in chosenpath.near_duplicates(chains, 85).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in chains.collect()], 85)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 163)] + [(5, 3), (4, 3), (5, 4)], "a long, b long")
    got = {r.id: r.root for r in chosenpath.components(links).collect()}
    assert got == {**{i: 100 for i in range(101, 164)}, 4: 3, 5: 3}


def test_null_ids_and_empty_tables(spark, odd_rows, no_rows):
    got = chosenpath.near_duplicates(odd_rows).collect()
    assert len(got) == odd_rows.count()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert rows_of(chosenpath.near_duplicates(no_rows)) == []


def test_overlaps_are_exact():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 300, n).astype(np.uint64)) for n in (0, 5, 90, 200, 150)]
    got = chosenpath.overlaps(sets[:3], sets[2:], columns=16)
    assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[2:]] for x in sets[:3]]
