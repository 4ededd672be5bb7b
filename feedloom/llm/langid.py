"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A letter trigram is the product ("binding") of its letters' vectors,
rotated ("permuted") by their places; a text is the sum ("bundle") of its trigrams' vectors, a language the sum of its
texts. A text gets the language with the largest cosine.

Sums of whole numbers do not depend on the order of rows, so every run learns the same prototypes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import slices, unused

UNKNOWN = "und"
#: Length of the vectors. The cosine of unrelated texts is off by about 1 / sqrt(DIMENSION).
DIMENSION = 512
#: Languages that prototypes are kept of; more are refused, as the prototypes are sent to every task.
MAX_LANGUAGES = 2048
#: Code points worked on at once. A longer text is cut into overlapping blocks whose trigrams add up.
BLOCK = 1 << 16
#: Texts bundled at once, and trigram vectors made at once: together they bound the matrices of a task.
OWNERS = 64
KINDS = 4096

_letter = np.zeros(0, bool)
_vectors: dict[int, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    global _letter
    if not _letter.size:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def _vector(code: int) -> np.ndarray:
    """The random vector of a letter (0: the gap between words), drawn from the code point itself."""
    if code not in _vectors:
        if len(_vectors) >= 1 << 14:
            _vectors.clear()
        bits = np.random.Generator(np.random.PCG64(code)).integers(0, 2, DIMENSION, np.int8)
        _vectors[code] = bits * np.int8(2) - np.int8(1)
    return _vectors[code]


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, each run of other characters as one 0, one 0 at either end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_is_letter()[codes], codes, 0)
    codes = np.concatenate([[0], codes, [0]]).astype(np.int64)
    keep = np.ones(codes.size, bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def bundle(pieces: list[np.ndarray], owners: list[int], n: int) -> np.ndarray:
    """Bundled trigram vectors by owner, an int64 matrix of ``n`` rows; ``pieces`` are results of :func:`letters`.

    At most ``BLOCK`` letters of ``OWNERS`` pieces are counted at once, and the vectors of ``KINDS`` trigrams made at once.
    """
    out = np.zeros((n, DIMENSION), np.int64)
    queue, who, size = [], [], 0

    def flush() -> None:
        nonlocal size
        if not queue:
            return
        codes = np.concatenate(queue)
        alphabet, ids = np.unique(codes, return_inverse=True)
        k, lengths = alphabet.size, np.array([p.size for p in queue])
        row = np.repeat(np.arange(len(queue)), lengths)
        inside = row[2:] == row[:-2]
        grams = ((ids[:-2] * k + ids[1:-1]) * k + ids[2:])[inside]
        pairs, counts = np.unique(grams * len(queue) + row[2:][inside], return_counts=True)
        kinds, at = np.unique(pairs // len(queue), return_inverse=True)
        rows = pairs % len(queue)
        table = np.stack([_vector(int(c)) for c in alphabet])
        sums = np.zeros((len(queue), DIMENSION), np.float32)
        for start in range(0, kinds.size, KINDS):
            some = kinds[start : start + KINDS]
            vectors = np.roll(table, 2, 1)[some // (k * k)] * np.roll(table, 1, 1)[some // k % k] * table[some % k]
            mine = slice(*np.searchsorted(at, [start, start + KINDS]))
            dense = np.zeros((len(queue), some.size), np.float32)
            dense[rows[mine], at[mine] - start] = counts[mine]
            # Whole numbers below 2**24 are exact in single precision.
            sums += dense @ vectors.astype(np.float32)
        np.add.at(out, who, sums.astype(np.int64))
        queue.clear(), who.clear()
        size = 0

    for codes, owner in zip(pieces, owners, strict=True):
        for at in range(0, max(codes.size - 2, 0), BLOCK):
            queue.append(codes[at : at + BLOCK + 2])
            who.append(owner)
            size += queue[-1].size
            if size >= BLOCK or len(queue) >= OWNERS:
                flush()
    flush()
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototype vector of each language of the rows whose text and language are not null.

    Every task sums its rows by language, so a language that holds a third of all rows moves no more than others.
    An empty table gives no prototypes, and then every text is ``und``.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            names = part.column("lang").to_pylist()
            kinds = {name: i for i, name in enumerate(dict.fromkeys(names))}
            rows = bundle([letters(t) for t in part.column("text").to_pylist()], [kinds[x] for x in names], len(kinds))
            for name, i in kinds.items():
                found[name] = found[name] + rows[i] if name in found else rows[i]
            if len(found) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
        for name, vector in found.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": [name] * DIMENSION, "at": pa.array(range(DIMENSION), pa.int32()), "n": pa.array(vector)})

    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    total = known.mapInArrow(sums, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    # At most MAX_LANGUAGES * DIMENSION numbers reach the driver.
    rows = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("v")).take(MAX_LANGUAGES + 1)
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    return {r.lang: np.array([x.n for x in r.v]) for r in sorted(rows, key=lambda r: r.lang)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) with ``lang_pred`` and ``score``, the cosine held between 0 and 1.

    A null text and one without any letter get ``und`` and 0. Of equal cosines the first language in code point order
    wins. Columns of ``docs`` named like the results are replaced.
    """
    names = list(prototypes)
    units = np.array([v / max(np.sqrt((v.astype(float) ** 2).sum()), 1.0) for v in prototypes.values()])
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    (body,) = unused(docs, "_text")
    source = docs.select(*columns, F.col(text).alias(body))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, body):
            codes = [letters(t or "") for t in part.column(body).to_pylist()]
            rows = bundle(codes, list(range(len(codes))), len(codes)).astype(float)
            empty = np.array([c.size < 3 for c in codes])
            if names:
                cosine = rows @ units.T / np.maximum(np.sqrt((rows**2).sum(1)), 1e-9)[:, None]
                best = cosine.argmax(1)
                value = np.where(empty, 0.0, cosine[np.arange(len(codes)), best].clip(0, 1))
                said = [UNKNOWN if e else names[b] for e, b in zip(empty, best, strict=True)]
            else:
                value, said = np.zeros(len(codes)), [UNKNOWN] * len(codes)
            kept = [part.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(said, pa.string()), pa.array(value)], [*columns, "lang_pred", "score"])

    schema = docs.select(*columns, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return source.mapInArrow(score, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of documents that training leaves out; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def language_id(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row of ``docs``; repeated rows stay repeated."""
    prototypes = train(docs.where(~held_out()))
    # The rows of the result keep no column of the input but the id: neither language nor source can leak in.
    found = predict(docs.select("doc_id", "text"), prototypes, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
