"""Lempel-Ziv phrase fingerprints.

A text is read as words (with the white space before them) and single other characters, and parsed like LZ78: the next
phrase is the shortest run of symbols that is not a phrase yet. The fingerprint is the sketch of the smallest hashes of
the phrase set; the likeness of two fingerprints estimates how far the texts' phrase dictionaries, and so their
compressed forms, agree. Sets smaller than the sketch are compared exactly.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import shuffle_partitions, slices

#: Hashes kept of a fingerprint; the likeness is off by about 0.5 / sqrt(SKETCH).
SKETCH = 64
# Letters of scripts written without spaces (from U+3000 on) are symbols of their own.
_SYMBOL = re.compile(r"\s?(?:[^\W　-\U0010FFFF]+|\W)|.", re.S)
_SMALLEST = -(1 << 63)


class _Phrases:
    """The phrase dictionary as a trie of numbers: the child of node ``p`` by symbol number ``s`` has the key ``p << 32 | s``.

    Node 0 is the empty phrase, node ``i + 1`` the phrase found as number ``i``. So a phrase costs one entry however long it is.
    """

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.keys: list[int] = []
        self.ends: list[int] = []  # number of symbols up to the end of each phrase

    def parse(self, symbols: list[str], nodes: dict[int, int]) -> None:
        """Go on with ``symbols`` behind a finished phrase; ``nodes`` maps the keys so far to ``node << 32`` and grows."""
        numbers, keys, ends, node = self.numbers, self.keys, self.ends, 0
        for symbol in dict.fromkeys(symbols):
            numbers.setdefault(symbol, len(numbers))
        for at, number in enumerate(map(numbers.__getitem__, symbols), 1):
            key = node | number
            node = nodes.get(key, 0)
            if not node:
                keys.append(key)
                ends.append(at)
                nodes[key] = len(keys) << 32

    def upto(self, symbols: int) -> tuple[_Phrases, dict[int, int]]:
        """The phrases that end within the first ``symbols``, to go on from there, and their nodes."""
        n = bisect.bisect_right(self.ends, symbols)
        other = _Phrases()
        other.numbers, other.keys, other.ends = self.numbers, self.keys[:n], self.ends[:n]
        return other, dict(zip(other.keys, range(1 << 32, n + 1 << 32, 1 << 32), strict=True))


def _hashes(text: str, cuts: list[int]) -> np.ndarray:
    """Hashes of the pieces of ``text`` between neighbouring ``cuts``."""
    return np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) >> 32 for a, b in pairwise(cuts)), np.uint32, max(len(cuts) - 1, 0))


def _sketch(*hashes: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate(hashes))[:SKETCH]


def fingerprint(text: str) -> np.ndarray:
    return TextPrint(text).sketch


class TextPrint:
    """The fingerprint of a text, with what is needed to go on from any of its symbols."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.symbols = _SYMBOL.findall(text)
        # Code points up to the end of each symbol, from 0 on.
        self.places = np.cumsum(np.fromiter((0, *map(len, self.symbols)), np.int64, len(self.symbols) + 1))
        self.phrases = _Phrases()
        self.phrases.parse(self.symbols, {})
        self.hashes = _hashes(text, self.places[[0, *self.phrases.ends]].tolist())
        self.sketch = _sketch(self.hashes)

    def edited(self, tail: str, cut: int) -> tuple[str, np.ndarray]:
        """The text with what follows ``cut`` replaced by ``tail``, and its fingerprint.

        Symbols that end before the cut are the same in both texts, so parsing goes on behind the last phrase of these.
        """
        new = self.text[:cut] + tail
        same = max(int(np.searchsorted(self.places, cut, "left")) - 1, 0)  # symbols that end before the cut
        phrases, nodes = self.phrases.upto(same)
        n = len(phrases.keys)
        done = phrases.ends[-1] if n else 0
        here = int(self.places[done])
        rest = _SYMBOL.findall(new, here)
        later = _Phrases()
        later.numbers, later.keys = phrases.numbers, phrases.keys
        later.parse(rest, nodes)
        places = np.cumsum(np.fromiter((here, *map(len, rest)), np.int64, len(rest) + 1))
        return new, _sketch(self.hashes[:n], _hashes(new, places[[0, *later.ends]].tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of phrases in both among those in either; 1 for two texts without phrases."""
    both = np.union1d(a, b)[:SKETCH]
    return float(np.isin(both, np.intersect1d(a, b)).mean()) if both.size else 1.0


def _hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its fingerprint, its edited text's, and its likeness to that and to the next document.

    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    The edit replaces the last ``floor(n_chars / 4)`` code points by as many first ones of the next document, or all it
    has. Documents follow each other by id (null first), repeated ids by text, and the first follows the last; a lone
    document follows itself. A null text is empty. A text is parsed as a whole, its dictionary grows with it.

    Ids are cut into ranges of about equal size; the first document of a range also goes to the range before it. So
    each task reads a run of consecutive documents and meets each one's successor without a global sort in one place.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    order = F.coalesce(F.col(key).cast("long"), F.lit(_SMALLEST))
    source = docs.select(F.col(key).cast("long").alias("doc_id"), order.alias("at"), F.coalesce(text, F.lit("")).alias("text"))
    ranges = 2 * n
    cuts = source.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)], 10000)).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            block, low = np.searchsorted(cuts, at, "right"), {}
            for b in np.unique(block):
                low[int(b)] = int(at[block == b].min())
            yield pa.RecordBatch.from_pydict({"block": pa.array(low.keys(), pa.int64()), "at": pa.array(low.values(), pa.int64())})

    # At most one row per range.
    firsts = source.select("at").mapInArrow(least, "block long, at long").groupBy("block").agg(F.min("at").alias("at")).collect()
    firsts = sorted((r.block, r["at"]) for r in firsts)
    before = {at: firsts[i - 1][0] for i, (_, at) in enumerate(firsts)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            first = np.flatnonzero(np.isin(at, list(before)))
            for rows, block, guest in (
                (batch, np.searchsorted(cuts, at, "right"), False),
                (batch.take(pa.array(first)), np.array([before[int(at[i])] for i in first]), True),
            ):
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block.astype(np.int64)), pa.array([guest] * rows.num_rows), *rows.columns], ["block", "guest", "doc_id", "at", "text"])

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def row_of(doc_id: int | None, own: TextPrint, following: TextPrint) -> tuple:
        size = len(own.text)
        new, sketch = own.edited(following.text[: size // 4], size - size // 4)
        return (doc_id, size, hashlib.sha256(new.encode()).hexdigest(), _hex(own.sketch), _hex(sketch),
                likeness(own.sketch, sketch), likeness(own.sketch, following.sketch))

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # block, id and print of the row whose successor comes next
        for part in slices(batches, "text"):
            out = []
            for row in part.to_pylist():
                if held is None or held[0] != row["block"]:
                    held = None
                elif held[1] == "guest":
                    continue  # further rows of the next range's first id
                own = TextPrint(row["text"])
                if held is not None:
                    out.append(row_of(held[1], held[2], own))
                held = (row["block"], "guest" if row["guest"] else row["doc_id"], own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) if any(v is not None for v in x) else pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)

    return (
        source.mapInArrow(dealt, "block long, guest boolean, doc_id long, at long, text string")
        .repartition(n, "block").sortWithinPartitions("block", "guest", "at", "text").mapInArrow(followed, schema)
    )
