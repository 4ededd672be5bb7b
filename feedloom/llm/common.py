"""Helpers of the text operators: slices of Arrow batches, byte hashes in NumPy, and registration of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import configure, cut_lineage

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}

#: A side is broadcast only when it was measured and has at most so many bytes.
BROADCAST_BYTES = 8 << 20


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan over the tables of a folder; ``sql`` computes the same rows by other means."""

    def register(plan: Plan) -> Plan:
        QUERIES[name] = lambda spark, sf_dir: plan(configure(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows of ``row_bytes`` each fit in :data:`BROADCAST_BYTES`.

    ``df`` should be a stored table, as it is counted here. Otherwise the join is left to the planner.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores added until ``df`` has no column of that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe from lost executors, pruned by column."""
    return cut_lineage(df)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of at most ``rows`` rows with about ``most`` bytes in column ``text``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, before + most, "right"))), at + rows)
            yield batch.slice(at, to - at)
            at = to


# Odd multipliers for hashes modulo 2**64; fixed, so that every process computes the same values.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Powers kept for the next slice; those of a longer text are made for it and dropped with it.
_KEPT_POWERS = 1 << 21


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or have.size < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= _KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of a byte array, for :func:`span_hash`."""
    out = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, data.size), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; equal bytes give equal hashes wherever they lie."""
    return mix((prefix[end] - prefix[start]) * _power(_INVERSE, prefix.size)[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts one after the other, and the number of words of each."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if data.size and not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, ends)
    return span_hash(prefix_hash(data), start, end), np.diff(upto, prepend=0)


#: Common tables that give ``crc``, the unsigned crc32 ``h`` of each text ``key`` of ``crc_keys``, half a byte at a time.
CRC_SQL = """crc_table AS (
    SELECT list(list_reduce(list_prepend(i, range(4)), lambda c, _: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS step FROM range(16) t(i)),
crc_code AS (SELECT key, hex(encode(key)) AS code FROM crc_keys),
crc AS (
    SELECT key, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(range(len(code)), lambda i: instr('0123456789ABCDEF', code[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) - 1)),
        lambda c, x: xor(c >> 4, step[(xor(c, x) & 15) + 1]))) AS h
    FROM crc_code, crc_table)"""
