"""Bloom filters of keys, kept as tables: an aggregate builds them, a join probes them.

The filter of a partition is cut into blocks of ``BLOCK_BITS`` bits. A key sets its bits in one block, so building groups by
block and probing joins on it; neither needs a whole filter in one place. The number of blocks is a power of two, so a filter
can be folded to any smaller size, and filters of one size merge by a bitwise or. A filter never denies a key it was built
from; about one in a hundred of the others passes and has to be looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the bits of one bitmap of the bitmap aggregates.
BLOCK_BITS = 32768
BITS_PER_KEY = 10
HASHES = 5


def blocks_for(n_keys: int) -> int:
    """Blocks of a partition with ``n_keys`` keys, a power of two."""
    blocks = 1
    while blocks * BLOCK_BITS < n_keys * BITS_PER_KEY:
        blocks *= 2
    return blocks


def block_of(keys: Sequence[str], blocks: Column) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(1)), blocks)


def positions(keys: Sequence[str]) -> Column:
    """The bits of a key in its block."""
    start, step = F.pmod(F.xxhash64(*keys, F.lit(2)), F.lit(BLOCK_BITS)), F.pmod(F.xxhash64(*keys, F.lit(3)), F.lit(BLOCK_BITS // 2)) * 2 + 1
    return F.array(*[F.pmod(start + i * step, F.lit(BLOCK_BITS)) for i in range(HASHES)])


def build(rows: DataFrame, keys: Sequence[str], blocks: int) -> DataFrame:
    """``part, block, bits`` of rows with ``part``: one filter of ``blocks`` blocks per partition.

    A bitmap for each of the hashes and then their union, so the rows are grouped as they are and not ``HASHES`` times.
    """
    placed = rows.select("part", block_of(keys, F.lit(blocks)).alias("block"), positions(keys).alias("_at"))
    single = placed.groupBy("part", "block").agg(*[F.bitmap_construct_agg(F.get("_at", F.lit(i))).alias(f"_{i}") for i in range(HASHES)])
    bits = single.select("part", "block", F.explode(F.array(*[f"_{i}" for i in range(HASHES)])).alias("_bits"))
    return bits.groupBy("part", "block").agg(F.bitmap_or_agg("_bits").alias("bits"))


def merge(filters: DataFrame, blocks: int) -> DataFrame:
    """One filter of ``blocks`` blocks per partition out of filters of that size or larger ones."""
    return filters.groupBy("part", F.pmod("block", F.lit(blocks)).alias("block")).agg(F.bitmap_or_agg("bits").alias("bits"))


def may_hold(bits: Column, at: Column) -> Column:
    """Whether all bits ``at`` (an array) are set in ``bits``."""

    def is_set(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(p, F.lit(8)).cast("int")) == 1

    return F.forall(at, is_set)
