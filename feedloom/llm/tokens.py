"""Token counts from counts per distinct pre-token.

A pre-token is a run of spaces with the text up to the next space. No piece of the vocabulary has a space behind another
character, and byte-pair merges never cross a boundary that no piece spans, so a text has as many pieces as its pre-tokens
have together. Tasks turn slices of documents into frequencies of pre-tokens per document; pre-tokens that are frequent
all over the corpus are counted first and looked up where they are found (they would otherwise be the hot keys), the rest
meets its count in one shuffle by pre-token. Ids exist for one list of distinct pre-tokens at a time and are only counted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import shuffle_partitions, slices

#: A pre-token found in this share of all documents is looked up in the list sent to every task. No more than
#: 1 / FREQUENT times the mean number of distinct pre-tokens of a document can be that frequent.
FREQUENT = 1 / 256
_MARK = "▁"  # how the model writes a space
_RUN = re.compile(f"[ {_MARK}]+[^ {_MARK}]*")
_models: dict[str, object] = {}


def model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def check_model(path: str) -> None:
    """Raise if a piece has a space behind another character: then pre-tokens could not be counted apart."""
    sp = model(path)
    if any(_MARK in sp.id_to_piece(i).lstrip(_MARK) for i in range(sp.get_piece_size())):
        raise ValueError("the vocabulary has pieces that span words")
    if sp.encode("a  b", out_type=str) == sp.encode("a b", out_type=str):
        raise ValueError("the model does not keep runs of spaces")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of the text behind one added space, each without its first space."""
    if not text:
        return []
    if text[0] == " " or "  " in text or _MARK in text:
        return [t[1:] for t in _RUN.findall(" " + text)]
    return text.split(" ")


def pieces(path: str, tokens: list[str]) -> list[int]:
    """Number of pieces of each pre-token; the empty one is a lone space, which is one piece."""
    return [len(x) if t else 1 for t, x in zip(tokens, model(path).encode(tokens, num_threads=1), strict=True)]


def _frequencies(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens, and per pair of document and pre-token: document, pre-token, frequency (by pre-token)."""
    index: dict[str, int] = {}
    seen, sizes = [], []
    for text in texts:
        found = pre_tokens(text or "")
        sizes.append(len(found))
        seen += [index.setdefault(t, len(index)) for t in found]
    docs = np.repeat(np.arange(len(texts)), sizes)
    pairs, freq = np.unique(np.array(seen, np.int64) * len(texts) + docs, return_counts=True)
    return list(index), pairs % max(len(texts), 1), pairs // max(len(texts), 1), freq


def frequent_pieces(docs: DataFrame, path: str, share: float = FREQUENT) -> dict[str, int]:
    """Pieces of the pre-tokens that a share of all documents holds. The list routes rows; counts do not depend on it."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 8 << 20, 1 << 20):
            words, _, token, _ = _frequencies(part.column("text").to_pylist())
            n = np.bincount(token, minlength=len(words))
            keep = np.flatnonzero(n >= max(2, share * part.num_rows))
            yield pa.RecordBatch.from_pydict({"token": [words[i] for i in keep], "n": pa.array(n[keep], pa.int64())})

    total = docs.count()
    rows = (
        docs.select("text").mapInArrow(found, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= share * total).select("token").collect()
    )
    words = [r.token for r in rows]
    return dict(zip(words, pieces(path, words), strict=True)) if words else {}


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every row; a null text has none of either, repeated rows stay."""
    check_model(path)
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_partitions = shuffle_partitions(spark)
    buckets = 2 * n_partitions
    known = spark.sparkContext.broadcast(frequent_pieces(source, path))
    posting = "bucket long, block long, ids array<long>, sizes array<long>, sums array<long>, words binary, lengths binary, spread binary, docs binary, freqs binary"

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((x, pa.list_(pa.int64())) for x in ("ids", "sizes", "sums")), *((x, pa.binary()) for x in ("words", "lengths", "spread", "docs", "freqs"))])
        block = TaskContext.get().partitionId() << 32
        for part in slices(batches, "text", 8 << 20, 1 << 20):
            block += 1
            texts = part.column("text").to_pylist()
            words, doc, token, freq = _frequencies(texts)
            have = np.array([known.value.get(w, -1) for w in words], np.int64)
            light = have[token] < 0 if words else np.zeros(0, bool)
            sums = np.bincount(doc[~light], have[token[~light]] * freq[~light], len(texts)).astype(np.int64)
            rows = [{"bucket": block % buckets, "block": block, "ids": part.column("doc_id").to_pylist(),
                     "sizes": [len((t or "").encode()) for t in texts], "sums": sums.tolist()}]
            rare = np.flatnonzero(have < 0)
            raw = [words[i].encode() for i in rare]
            bucket = np.array([zlib.crc32(w) % buckets for w in raw], np.int64)
            doc, freq, spread = doc[light], freq[light], np.bincount(token[light], minlength=len(words))[rare] if words else rare
            first = np.concatenate([[0], np.cumsum(spread)])  # pairs are in the order of the pre-tokens
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)) if rare.size else []
            for mine in np.split(order, cuts[1:]) if rare.size else []:
                at = np.concatenate([np.arange(first[i], first[i + 1]) for i in mine])
                own = [raw[i] for i in mine]
                rows.append({"bucket": int(bucket[mine[0]]), "block": block, "words": b"".join(own),
                             "lengths": np.array([len(w) for w in own], np.uint32).tobytes(), "spread": spread[mine].astype(np.uint32).tobytes(),
                             "docs": doc[at].astype(np.uint32).tobytes(), "freqs": freq[at].astype(np.uint32).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema)

    partial = "block long, ids array<long>, sizes array<long>, sums array<long>, docs binary, counts binary"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), *((x, pa.list_(pa.int64())) for x in ("ids", "sizes", "sums")), ("docs", pa.binary()), ("counts", pa.binary())])
        cache: dict[str, int] = {}
        for row in (r for batch in batches for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist()):
            if row["words"] is None:
                yield pa.RecordBatch.from_pylist([{x: row[x] for x in ("block", "ids", "sizes", "sums")}], schema)
                continue
            ends = np.cumsum(np.frombuffer(row["lengths"], np.uint32)).tolist()
            words = [row["words"][a:b].decode() for a, b in zip([0, *ends], ends)]
            new = [w for w in words if w not in cache]
            cache.update(zip(new, pieces(path, new), strict=True))
            n = np.repeat([cache[w] for w in words], np.frombuffer(row["spread"], np.uint32)) * np.frombuffer(row["freqs"], np.uint32)
            docs, at = np.unique(np.frombuffer(row["docs"], np.uint32), return_inverse=True)
            total = np.bincount(at, n).astype(np.int64)
            yield pa.RecordBatch.from_pylist([{"block": row["block"], "docs": docs.tobytes(), "counts": total.tobytes()}], schema)

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows["docs"].isna()].iloc[0]
        total = np.array(head["sums"], np.int64)
        for docs, counts in rows.loc[rows["docs"].notna(), ["docs", "counts"]].itertuples(index=False):
            total[np.frombuffer(docs, np.uint32)] += np.frombuffer(counts, np.int64)
        ids = pd.array(list(head["ids"]), "Int64") if len(head["ids"]) else []
        return pd.DataFrame({"doc_id": ids, "n_bytes": head["sizes"], "n_tokens": total})

    return (
        source.mapInArrow(postings, posting).repartition(n_partitions, "bucket").mapInArrow(counted, partial)
        .groupBy("block").applyInPandas(summed, "doc_id long, n_bytes long, n_tokens long")
    )
