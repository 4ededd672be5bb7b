"""Spelling variants, periodic runs and byte pairs against brute force and the tokenizer library."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from feedloom.llm import bpe, permuterm, runs
from feedloom.llm.queries import BYTE_TOKENIZER, QUERIES, tokenizer_path

SF_DIR = "/root/testdata/sf0.001"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# Periodic runs


def brute_runs(words: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """Maximal stretches of every period, without those whose smallest period is another."""
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            start, length = i, end + q - i
            part = words[start : start + length]
            smallest = next(p for p in range(1, q + 1) if part[p:] == part[:-p])
            if length >= max(least, exponent * q) and smallest == q:
                out.append((start, length, q))
            i = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(3)
    documents = []
    for _ in range(1500):
        said = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            block = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
            at = rng.randrange(len(said) + 1)
            said[at:at] = (block * 9)[: rng.randrange(1, len(block) * 9)]
        documents.append(said)
    for exponent, least in ((4, 6), (2, 2), (3, 1)):
        found = runs.find_runs([np.array(d, np.int64) for d in documents], least, exponent)
        assert found == [brute_runs(d, least, exponent) for d in documents]
    assert sum(map(len, found)) > 1000


def test_runs_at_document_borders():
    same = np.zeros(9, np.int64)
    assert runs.find_runs([same, same, np.zeros(0, np.int64), same]) == [[(0, 9, 1)], [(0, 9, 1)], [], [(0, 9, 1)]]
    with pytest.raises(ValueError):
        runs.find_runs([same], exponent=1)


def with_periods(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_run_report(doc_id, text):
    words = with_periods(doc_id, text)
    found = brute_runs(words)
    keep = [not any(s + q <= i < s + m for s, m, q in found) for i in range(len(words))]
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()),
        sha(" ".join(w for w, k in zip(words, keep, strict=True) if k).encode()),
    )


def test_run_report(spark, mixed):
    got = Counter(map(tuple, runs.run_report(mixed).collect()))
    short = [r for r in mixed.collect() if len(r.text or "") < 8000]
    want = Counter(brute_run_report(r.doc_id, r.text) for r in short)
    assert {k for k in got if k in want} == set(want) and all(got[k] == n for k, n in want.items())
    assert sum(got.values()) == mixed.count() and sum(r[1] for r in want) > 10


def test_long_run_and_empty_table(spark, no_rows, odd_rows):
    text = odd_rows.where("doc_id = 7").first().text

    long = {r.doc_id: r for r in runs.periodic_runs(odd_rows).where("doc_id in (7, 11)").collect()}
    words = 13 * 4000
    assert [tuple(r) for r in long[7].runs] == [(0, words, 13)] and long[7].n_words == words
    assert long[7].collapsed.decode() == " ".join(text.split()[:13])
    assert runs.run_report(no_rows).count() == 0


def test_query_of_runs(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF_DIR).collect()}
    assert got.keys() == {r.doc_id for r in docs}
    for r in docs:
        if len(r.text or "") < 8000:
            assert got[r.doc_id] == brute_run_report(r.doc_id, r.text)


# Spelling variants


def brute_words(rows) -> Counter:
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{low}".encode()) if doc_id is not None else 1
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= 6:
                out[low] += 1
    return Counter({w: n for w, n in out.items() if n >= 5})


def near(x: str, y: str) -> bool:
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute_forms(words: dict) -> set:
    by = defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    forms, counts = {}, {}
    for w, n in words.items():
        found = [u for size in (len(w) - 1, len(w), len(w) + 1) for u in by[size] if u != w and near(w, u)]
        best = min(found, key=lambda u: (-words[u], u), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
        counts[w] = len(found)
    out = set()
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, n, counts[w], forms[w], words[forms[w]] if forms[w] else None, root))
    return out


def test_forms_of_random_words(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randrange(0, 6))): rng.choice([1, 2, 5, 30, 30, 700, 20000]) for _ in range(600)}
    words |= {"\x00": 3, "a\x00": 40, "a\x00a": 2, "😀a": 7, "😀": 35}
    base = "".join(rng.choice("abc") for _ in range(permuterm.LONG_GAP - 1))
    for extra in range(4):  # words about and beyond the bound of literal gaps
        base += rng.choice("abc")
        for _ in range(8):
            at = rng.randrange(len(base))
            words |= {base[:at] + "x" + base[at + 1 :]: rng.randrange(1, 9), base[:at] + base[at + 1 :]: rng.randrange(1, 60)}
        words[base] = 10 ** (extra + 2)
    long = "ab" * 3000
    words |= {long: 100, long[:-1]: 3, "c" + long[1:]: 4, "c" + long: 1}
    table = spark.createDataFrame([*words.items(), (None, 3)], "word string, n int").repartition(4)
    got = [tuple(r) for r in permuterm.spelling_forms(table).collect()]
    assert len(got) == len(words) and set(got) == brute_forms(words)
    assert len({r[5] for r in got}) < len(got) - 100


def test_words_of_odd_rows(spark, odd_rows, no_rows):
    rows = [(r.doc_id, r.text) for r in odd_rows.collect()]
    assert {r.word: r.n for r in permuterm.corpus_words(odd_rows).collect()} == dict(brute_words(rows))
    assert permuterm.spelling_forms(permuterm.corpus_words(no_rows)).count() == 0
    with pytest.raises(ValueError):
        permuterm.spelling_forms(permuterm.corpus_words(no_rows), 1)


def test_query_of_spelling(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = QUERIES["op11_spelling_variants"](spark, SF_DIR)
    found = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()]
    want = brute_forms(brute_words(rows))
    assert len(found) == len(want) and set(found) == want and any(r[3] for r in found)


# Byte pairs


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(BYTE_TOKENIZER))


def test_encoding_of_odd_texts(library):
    coder = bpe.vocabulary(tokenizer_path(BYTE_TOKENIZER))
    rng = random.Random(4)
    letters = "aab bB  \n\t'lsre0123!?.é中🙂 　\x00\x85ﬁİ한글абв՘\U00012650\U00010940"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)]
    pieces = list(coder.pieces.values())
    texts += ["".join(p.decode("utf-8", "ignore") for p in rng.choices(pieces, k=rng.randrange(1, 9))) for _ in range(4000)]
    texts += ["a" * 5000, "<|endoftext|>", "x<|endoftext|> y  <|endoftext|><|endoftext|>  ", "<|endoftext", " " * 3000, "中" * 999, ""]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(4000))]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want
    said = library.decode_batch([np.frombuffer(x, "<u4").tolist() for x in want], skip_special_tokens=False)
    assert [coder.decode(x) for x in want] == said
    assert coder.decode(want[0][:0]) == "" and coder.encode([None]) == [b""]


def test_bounds_do_not_change_ids(library, monkeypatch):
    texts = [r * 3 for r in ("the cat sat <|endoftext|> on  the mat\n\n and it's there ", "word" * 90 + " word", " \n ")]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    for name, value in (("CHUNK", 5), ("REMEMBERED", 3), ("REMEMBERED_PAIRS", 2), ("LONG_WORD", 4)):
        monkeypatch.setattr(bpe, name, value)
        coder = bpe.Vocabulary(tokenizer_path(BYTE_TOKENIZER))
        assert coder.encode(texts) == want and coder.encode(texts[::-1]) == want[::-1]
        assert all(len(w) <= bpe.LONG_WORD for w in coder.known)


def test_round_trip(spark, mixed, no_rows, library):
    path = tokenizer_path(BYTE_TOKENIZER)
    rows = [(r.doc_id, r.text or "") for r in mixed.collect()]
    want = Counter()
    for (doc_id, text), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True):
        back = library.decode(e.ids, skip_special_tokens=False)
        want[doc_id, len(e.ids), sha(np.array(e.ids, "<u4").tobytes()), sha(back.encode())] += 1
    assert Counter(map(tuple, bpe.round_trip(mixed, path).collect())) == want
    assert bpe.round_trip(no_rows, path).count() == 0
    broken = spark.createDataFrame([(1, None), (2, bytearray(np.array([162], "<u4").tobytes()))], "doc_id long, ids binary")
    assert [r.text is None for r in bpe.decode(broken, path).orderBy("doc_id").collect()] == [True, False]
    assert QUERIES["op13_bpe_round_trip"](spark, SF_DIR).count() == 200


def test_files_that_are_not_understood(tmp_path):
    import json

    with open(tokenizer_path(BYTE_TOKENIZER), encoding="utf-8") as file:
        said = json.load(file)
    said["normalizer"] = {"type": "NFC"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(path))
