"""Counts of hashed character n-grams, in NumPy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasNumFeatures, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# Text that is hashed at once, in bytes of whole rows or characters of a longer one: the arrays stay in a core's cache.
BLOCK = 1 << 15

_VECTOR = pa.struct([
    pa.field("type", pa.int8(), False), pa.field("size", pa.int32()),
    pa.field("indices", pa.list_(pa.field("element", pa.int32(), False))),
    pa.field("values", pa.list_(pa.field("element", pa.float64(), False))),
])


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint32(bits)) | (x >> np.uint32(32 - bits))


def _scrambled(k: np.ndarray) -> np.ndarray:
    return _rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def murmur3(words: np.ndarray, at: np.ndarray, length: int, seed: int = 42) -> np.ndarray:
    """32-bit Murmur3 hashes of the ``length`` bytes from each ``at``; ``words[i]`` are the four bytes from ``i``."""
    h = np.full(at.size, seed, np.uint32)
    whole, rest = divmod(length, 4)
    for i in range(whole):
        h = _rotated(h ^ _scrambled(words[at + 4 * i]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    if rest:
        h ^= _scrambled(words[at + 4 * whole] & np.uint32((1 << 8 * rest) - 1))
    h ^= np.uint32(length)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _buckets(data: np.ndarray, starts: np.ndarray, row: np.ndarray, n: int, features: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and bucket of every n-gram of UTF-8 ``data``, whose characters have these ``starts`` and rows.

    A gram is hashed as ``HashingTF`` hashes it when ``NGram`` has made it: its characters with spaces between them.
    """
    if row.size < n:
        return
    at = np.append(starts, data.size) + np.arange(row.size + 1)
    text = np.ones(data.size + row.size + 3, bool)
    text[at[1:] - 1] = text[at[-1] :] = False
    spaced = np.full(text.size, 32, np.uint8)
    np.place(spaced, text, data)
    # A copy, as NumPy is slow to pick single words that are not aligned.
    words = np.ndarray(spaced.size - 3, "<u4", spaced, strides=(1,)).copy()
    sizes = (at[n:] - 1 - at[:-n]).astype(np.int32)
    sizes[row[n - 1 :] != row[: row.size - n + 1]] = 0
    for size in np.flatnonzero(np.bincount(sizes)):
        if size:
            mine = np.flatnonzero(sizes == size)
            yield row[mine], np.mod(murmur3(words, at[mine], int(size)).view(np.int32), np.int32(features))


def _runs(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each comes or the sum of its counts."""
    if counts is not None:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.append(0, np.cumsum(counts[order]))
    else:
        keys, counts = np.sort(keys), np.arange(keys.size + 1)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.zeros(0, np.int64)
    return keys[first], np.diff(counts[np.append(first, keys.size)])


def gram_counts(texts: pa.Array, n: int, features: int) -> pa.StructArray:
    """A sparse vector for each of the ``texts``: how often n-grams fall into each bucket. Null is an error."""
    if texts.null_count:
        raise ValueError("a text is null")
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.searchsorted(starts, ends - ends[0])))
    found, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for at in range(0, row.size, BLOCK):
        some = slice(at, at + BLOCK + n - 1)
        end = starts[some.stop] if some.stop < starts.size else data.size
        part = _buckets(data[starts[at] : end], starts[some] - starts[at], row[some], n, features)
        keys, times = _runs(np.concatenate([rows * np.int32(features) + buckets for rows, buckets in part] or [found[:0]]))
        found, counts = _runs(np.append(found, keys), np.append(counts, times)) if found.size else (keys, times)
    offsets = np.searchsorted(found, np.arange(len(texts) + 1) * features).astype(np.int32)
    return pa.StructArray.from_arrays([
        pa.array(np.zeros(len(texts), np.int8)), pa.array(np.full(len(texts), features, np.int32)),
        pa.ListArray.from_arrays(offsets, pa.array(found % np.int32(features)), type=_VECTOR.field("indices").type),
        pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.float64)), type=_VECTOR.field("values").type),
    ], fields=list(_VECTOR))


def _slices(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``most`` rows with at most ``BLOCK`` bytes in column ``text``, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right"))
        to = min(max(fit, at + 1), at + most)
        yield batch.slice(at, to - at)
        at = to


class GramCounts(Transformer, HasInputCol, HasOutputCol, HasNumFeatures, DefaultParamsReadable, DefaultParamsWritable):
    """Text to the vector that splitting it into lower-case characters, ``NGram`` and ``HashingTF`` give."""

    n = Param(Params._dummy(), "n", "characters of a gram", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, n: int = 3, inputCol: str | None = None, outputCol: str | None = None, numFeatures: int = 1 << 14):
        super().__init__()
        self._setDefault(n=3, numFeatures=1 << 14)
        self._set(**self._input_kwargs)

    def counted(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Columns ``keep`` and the vectors."""
        n, features, out = self.getOrDefault(self.n), self.getNumFeatures(), self.getOutputCol()
        most = max(1, (1 << 31) // features - 1)  # row and bucket make one 32-bit key

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _slices(batch, len(keep), most):
                    *kept, texts = part.columns
                    yield pa.RecordBatch.from_arrays([*kept, gram_counts(texts, n, features)], names=[*keep, out])

        source = df.select(*keep, F.lower(self.getInputCol()).alias(out))
        schema = StructType([*df.select(*keep).schema.fields, StructField(out, VectorUDT())])
        # The number of features as MLlib notes it; else it reads a row to find it.
        sized = F.col(out).alias(out, metadata={"ml_attr": {"num_attrs": features}})
        return source.mapInArrow(rows, schema).select(*keep, sized)

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.counted(df, df.columns)
