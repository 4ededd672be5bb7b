"""Exact substring dedup by distributed prefix doubling over anchored positions.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller id. Prefix doubling names all
positions by their first h bytes, drops those whose name is unique, and goes on with longer prefixes of the rest. Names
here are hashes, and only anchors are named: in every window of ``LENGTH`` bytes the gram of ``GRAM`` bytes with the
smallest hash, a choice that depends on the window alone, so equal windows have equal anchors at the same place in them.

1. Names of length ``GRAM``: anchors are dealt by their gram and sorted; a gram that occurs once ends there.
2. Names of the next length: the text around an anchor, as far as the windows reach that it stands for. Anchors with
   equal text around them are settled: every window of the one in the larger document repeats.
3. Grams that stand in different texts fetch these texts and are named at every position by all ``LENGTH`` bytes.

Documents are dealt to blocks once; the steps move 15 bytes per anchor, and texts only for step 3. A block sends of equal
names those of its first document alone, so a passage shared by a third of all documents is one row per block.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import prefix_hash, shuffle_partitions, span_hash

LENGTH = 50
GRAM = 20
#: Text of a block, on average; starts of windows named at once.
BLOCK_BYTES = 8 << 20
CHUNK = 1 << 16
_FIRST = -(1 << 63)
_ROW = "bucket long, block long, kind int, body binary"
_ENTRIES, _ANSWER, _REQUEST, _TEXTS = range(4)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Running hash sums of ``data``, and of each anchor its place and the first and last start of its windows.

    ``data`` holds documents one after the other, ``ends`` where each ends; windows lie inside one document.
    """
    prefix = prefix_hash(data)
    grams = LENGTH - GRAM + 1
    at = np.arange(max(data.size - GRAM + 1, 0))
    low, where = span_hash(prefix, at, at + GRAM), at.astype(np.int32)
    width = 1
    while width < grams:  # minima of runs of 2, 4, 8, ... grams; of equal ones the first
        step = min(width, grams - width)
        right = low[step:] < low[:-step]
        where = np.where(right, where[step:], where[:-step])
        low = np.where(right, low[step:], low[:-step])
        width += step
    starts = np.arange(where.size)
    inside = np.zeros(where.size, bool) if not where.size else starts + LENGTH <= ends[np.searchsorted(ends, starts, "right")]
    starts, where = starts[inside], where[inside]
    new = np.ones(starts.size, bool)
    new[1:] = (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], starts.size)[: first.size] - 1
    return prefix, where[first].astype(np.int64), starts[first], starts[last]


def _names(block: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all anchors of a block: gram name, name of the text around, first start, number of starts."""
    out, data, begin = [], np.frombuffer(block, np.uint8), 0
    sizes = np.diff(ends, prepend=0)
    for stop in [*np.flatnonzero(np.diff(ends // CHUNK)) + 1, ends.size]:
        if stop <= begin:
            continue
        at, upto = int(ends[begin] - sizes[begin]), int(ends[stop - 1])
        runs = [(at, upto, ends[begin:stop] - at)]
        if upto - at > 4 * CHUNK:  # a long document in it: pieces that share all but one byte of a window
            runs = []
            for i in range(begin, stop):
                a, b = int(ends[i] - sizes[i]), int(ends[i])
                runs += [(s, min(s + CHUNK + LENGTH - 1, b), np.array([min(s + CHUNK + LENGTH - 1, b) - s])) for s in range(a, max(b, a + 1), CHUNK)]
        for a, b, cuts in runs:
            prefix, place, lo, hi = anchors(data[a:b], cuts)
            gram = span_hash(prefix, place, place + GRAM)
            around = span_hash(prefix, lo, hi + LENGTH) + (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out.append((gram >> np.uint64(16), around >> np.uint64(16), lo + a, hi - lo + 1))
        begin = stop
    if not out:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pack(*columns: np.ndarray) -> bytes:
    """Whole numbers as differences in byte planes: bytes that are all zero cost next to nothing once compressed."""
    planes = []
    for c in columns:
        c = np.ascontiguousarray(c.astype(np.uint64))
        planes.append(c.view(np.uint8).reshape(-1, 8).T.tobytes())
    return pickle.dumps(planes, 5)


def _unpack(body: bytes) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(8, -1).T).view(np.uint64).ravel() for p in pickle.loads(body)]


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.zeros(1, values.dtype)).astype(np.uint64)


def _sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps).astype(np.int64)


def _block(docs: pd.DataFrame) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids, texts and ends of a block's documents in a fixed order."""
    texts = [(t or "").encode() for t in docs["text"]]
    order = sorted(range(len(texts)), key=lambda i: (docs["order"].iat[i], texts[i]))
    texts = [texts[i] for i in order]
    return docs["order"].to_numpy(np.int64)[order], texts, np.cumsum([len(t) for t in texts])


def _covered(lo: np.ndarray, n: np.ndarray) -> bytes:
    order = np.argsort(lo, kind="stable")
    return _pack(_steps(lo[order]), n[order])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "block", "kind", "body"])


def _repeats(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row whether its name occurs in a smaller document, and whether it is in its name's first document."""
    _, at = np.unique(name, return_inverse=True)
    first = np.full(at.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, at, doc)
    return doc > first[at], doc == first[at]


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every row.

    Texts are UTF-8 bytes, null ones empty. A null id counts as the smallest. Rows that share an id are told apart, and
    none of them repeats another, as none is smaller. Texts below 50 bytes keep all.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    order = F.coalesce(F.col(key).cast("long"), F.lit(_FIRST))
    source = docs.select(F.col(key).cast("long").alias("doc_id"), order.alias("order"), F.col(text).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(n, math.ceil(total / BLOCK_BYTES)), 2 * n
    # Dealt once: the three uses below read the same shuffle files.
    dealt = source.withColumn("block", F.pmod(F.xxhash64("order"), F.lit(blocks))).groupBy("block")

    def named(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, texts, ends = _block(pdf)
        block = int(pdf["block"].iat[0])
        gram, around, lo, n_starts = _names(b"".join(texts), ends)
        doc = ids[np.searchsorted(ends, lo, "right")] if lo.size else lo
        again, first = _repeats(gram * np.uint64(0x9E3779B97F4A7C15) ^ around, doc)
        rows = []
        if again.any():
            rows.append((block % buckets, block, _ANSWER, _covered(lo[again], n_starts[again] + LENGTH - 1)))
        bucket = (gram[first] % np.uint64(buckets)).astype(np.int64)
        gram, around, lo, n_starts, doc = (x[first] for x in (gram, around, lo, n_starts, doc))
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
        for mine in np.split(by, cuts[1:]) if by.size else []:
            body = _pack(gram[mine], around[mine], _steps(doc[mine]), _steps(lo[mine]), n_starts[mine])
            rows.append((int(bucket[mine[0]]), block, _ENTRIES, body))
        return _frame(rows)

    def matched(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(r) for r in pdf[pdf["kind"] == _ANSWER].itertuples(index=False)]
        mine = pdf[pdf["kind"] == _ENTRIES]
        if not len(mine):
            return _frame(rows)
        parts = [_unpack(b) for b in mine["body"]]
        gram, around, n_starts = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 4))
        doc, lo = (np.concatenate([_sums(p[i]) for p in parts]) for i in (2, 3))
        block = np.repeat(mine["block"].to_numpy(np.int64), [p[0].size for p in parts])
        again, first = _repeats(gram * np.uint64(0x9E3779B97F4A7C15) ^ around, doc)
        # Grams in more than one text around: their first documents must be compared window by window.
        _, at = np.unique(gram, return_inverse=True)
        some = np.full(at.max(initial=-1) + 1, 0, np.uint64)
        some[at] = around
        mixed = np.zeros(some.size, bool)
        np.logical_or.at(mixed, at, around != some[at])
        ask = first & mixed[at]
        for b in np.unique(block[again | ask]):
            hit, open_ = again & (block == b), ask & (block == b)
            if hit.any():
                rows.append((int(b) % buckets, int(b), _ANSWER, _covered(lo[hit], n_starts[hit] + LENGTH - 1)))
            if open_.any():
                rows.append((int(b) % buckets, int(b), _REQUEST, _pack(gram[open_], lo[open_], n_starts[open_])))
        return _frame(rows)

    def fetched(asked: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(r) for r in asked[asked["kind"] == _ANSWER].itertuples(index=False)]
        parts = [_unpack(b) for b in asked.loc[asked["kind"] == _REQUEST, "body"]]
        if not parts:
            return _frame(rows)
        ids, texts, ends = _block(pdf)
        data, block = np.frombuffer(b"".join(texts), np.uint8), int(pdf["block"].iat[0])
        gram, lo, n_starts = (np.concatenate([p[i] for p in parts]) for i in range(3))
        lo, size = lo.astype(np.int64), n_starts.astype(np.int64) + LENGTH - 1
        by = np.lexsort((lo, gram % np.uint64(buckets)))
        gram, lo, size = gram[by], lo[by], size[by]
        bucket = (gram % np.uint64(buckets)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for mine in np.split(np.arange(lo.size), cuts[1:]):
            texts = b"".join(data[a : a + s].tobytes() for a, s in zip(lo[mine], size[mine], strict=True))
            doc = ids[np.searchsorted(ends, lo[mine], "right")]
            rows.append((int(bucket[mine[0]]), block, _TEXTS, pickle.dumps((_pack(_steps(doc), _steps(lo[mine]), size[mine]), texts), 5)))
        return _frame(rows)

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(r) for r in pdf[pdf["kind"] == _ANSWER].itertuples(index=False)]
        names, docs_, places, blocks_ = [], [], [], []
        for block, body in pdf.loc[pdf["kind"] == _TEXTS, ["block", "body"]].itertuples(index=False):
            head, texts = pickle.loads(body)
            doc, lo, size = _unpack(head)
            size = size.astype(np.int64)
            ends = np.cumsum(size)
            data, windows = np.frombuffer(texts, np.uint8), size - LENGTH + 1
            entry = np.repeat(np.arange(size.size), windows)
            inner = np.arange(entry.size) - np.repeat(np.cumsum(windows) - windows, windows)
            start = (ends - size)[entry] + inner
            names.append(span_hash(prefix_hash(data), start, start + LENGTH))
            docs_.append(_sums(doc)[entry])
            places.append(_sums(lo)[entry] + inner)
            blocks_.append(np.full(entry.size, block))
        if names:
            again, _ = _repeats(np.concatenate(names), np.concatenate(docs_))
            place, block = np.concatenate(places)[again], np.concatenate(blocks_)[again]
            for b in np.unique(block):
                lo = np.unique(place[block == b])
                rows.append((int(b) % buckets, int(b), _ANSWER, _covered(lo, np.full(lo.size, LENGTH))))
        return _frame(rows)

    def cut(answers: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, texts, ends = _block(pdf)
        total = int(ends[-1]) if ends.size else 0
        change = np.zeros(total + 1, np.int32)
        for body in answers["body"]:
            steps, size = _unpack(body)
            lo = _sums(steps)
            np.add.at(change, lo, 1)
            np.add.at(change, lo + size.astype(np.int64), -1)
        gone = np.cumsum(change[:-1]) > 0
        known = dict(zip(pdf["order"], pdf["doc_id"], strict=True))
        out = []
        for doc, body, end in zip(ids, texts, ends, strict=True):
            mask = gone[end - len(body) : end]
            spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
            kept = np.frombuffer(body, np.uint8)[~mask].tobytes() if spans else body
            out.append((known[doc], len(body), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
        result = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        return result.astype({"doc_id": "Int64"})

    entries = dealt.applyInPandas(named, _ROW)
    first = entries.groupBy("bucket").applyInPandas(matched, _ROW)
    texts = first.groupBy("block").cogroup(dealt).applyInPandas(fetched, _ROW)
    second = texts.groupBy("bucket").applyInPandas(compared, _ROW)
    return second.groupBy("block").cogroup(dealt).applyInPandas(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: The query over ``documents``, from all windows of 50 bytes; texts are cut into short pieces first.
SQL = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
-- Pieces of 128 starts, so that taking a window does not walk through a long text.
pieces AS (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0), 128)) AS place FROM bytes),
cut AS (SELECT doc_id, place, substr(h, 2 * place + 1, 2 * (128 + 49)) AS piece FROM pieces),
windows AS (
    SELECT doc_id, place + i AS start, unhex(substr(piece, 2 * i + 1, 100)) AS name
    FROM (SELECT doc_id, place, piece, unnest(range(0, len(piece) // 2 - 49)) AS i FROM cut)),
firsts AS (SELECT name, min(doc_id) AS first_doc FROM windows GROUP BY name HAVING count(*) > 1),
repeated AS (SELECT doc_id, start FROM windows JOIN firsts USING (name) WHERE doc_id > first_doc),
marked AS (
    SELECT doc_id, start, CASE WHEN start > lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 50 THEN 1 ELSE 0 END AS fresh FROM repeated),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM marked),
spans AS (SELECT doc_id, min(start) AS lo, max(start) + 50 AS hi FROM numbered GROUP BY doc_id, span),
gaps AS (
    SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans),
kept AS (
    SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, max(hi) AS upto,
        string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head
    FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN upto IS NULL THEN h ELSE head || substr(h, 2 * upto + 1) END)) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)
"""
