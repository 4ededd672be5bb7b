"""Grouped work that stays balanced when one key holds a large share of the rows.

Three shapes cover every operator of this package:

* aggregates: plain ``groupBy().agg()``, whose map-side combine already sends one row per key and task;
* lookups of a unique-key table (:func:`salted_join`): rows of hot keys are spread over salts;
* order-dependent folds (:func:`earlier`, :func:`since_reset`): a group is cut into chunks of
  consecutive rows; each chunk is folded on its own, and only one row per chunk is folded again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 1_000
TRACKED_KEYS = 10_000
MAX_SALTS = 4_096
CHUNK_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 32 << 20
# What a row takes in memory beside its values.
ROW_BYTES = 48


def chunk_of(seq: str, width: int = CHUNK_ROWS) -> Column:
    """Chunk number of a dense integer sequence; grows with ``seq`` as the folds below require."""
    return F.expr(f"`{seq}` div {int(width)}")


def hot_keys(rows: DataFrame, key: str) -> dict[Any, int]:
    """Number of salts for each key with at least ``HOT_ROWS`` rows, from one pass over the key column.

    The frequent keys come from a mergeable sketch: every task sends a bounded summary and no key is
    shuffled. At most ``MAX_HOT_KEYS`` reach the driver. The sketch only decides where rows travel; a key it
    misses is joined all the same, and holds too small a share of the rows to matter.
    """
    top = rows.where(F.col(key).isNotNull()).select(F.expr(f"approx_top_k(`{key}`, {MAX_HOT_KEYS}, {TRACKED_KEYS})"))
    found = top.first()[0] or []
    return {r["item"]: min(-(-r["count"] // HOT_ROWS) + 1, MAX_SALTS) for r in found if r["count"] >= HOT_ROWS}


def hinted(table: DataFrame, hint: str | None) -> DataFrame:
    return table if hint is None else table.hint(hint)


def salted_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    spread: Sequence[str],
    how: str = "left",
    hot: dict[Any, int] | None = None,
    hint: str | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table`` (unique on ``key``) with the rows of hot keys spread over salts.

    Without hot keys this is a plain join. The salt is a hash of the ``spread`` columns, not a random number, so
    that a task that runs again sends each row to the same place. Only table rows of hot keys are copied. ``hint`` is a
    join hint for the table, such as ``shuffle_hash`` where it is narrow and the rows are wide: then rows are not sorted.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(hinted(table, hint), key, how)
    schema = StructType([StructField(key, rows.schema[key].dataType), StructField("_copies", IntegerType())])
    # At most MAX_HOT_KEYS rows.
    salts = F.broadcast(rows.sparkSession.createDataFrame(list(hot.items()), schema))
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    left = rows.join(salts, key, "left").withColumn("_salt", F.pmod(F.hash(*spread), copies)).drop("_copies")
    right = (
        table.join(salts, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
        .drop("_copies")
    )
    return left.join(hinted(right, hint), [key, "_salt"], how).drop("_salt")


def fits_broadcast(rows: DataFrame) -> bool:
    """Whether the rows, measured by a count of rows and bytes, are within ``MAX_BROADCAST_BYTES``."""
    text = F.octet_length(F.to_json(F.struct(*rows.columns)))
    size = rows.agg(F.sum(text + ROW_BYTES)).first()[0] or 0
    return size <= MAX_BROADCAST_BYTES


def bounded(keys: DataFrame) -> DataFrame:
    """``keys`` marked for broadcast if they are measured to fit, else as they are."""
    return F.broadcast(keys) if fits_broadcast(keys) else keys


def restrict(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], unique: bool = False, hint: str | None = None) -> DataFrame:
    """The rows of a large table whose keys occur in ``wanted`` (``unique`` says that each key occurs once there).

    For few keys the table is filtered where it is read, for many both sides are moved by key. With a join ``hint`` the
    keys are not measured.
    """
    few = wanted.select(*keys) if unique else wanted.select(*keys).distinct()
    return rows.join(bounded(few) if hint is None else hinted(few, hint), list(keys), "left_semi")


def measured_join(
    rows: DataFrame, table: DataFrame, key: str, spread: Sequence[str], how: str = "left", hot: dict[Any, int] | None = None
) -> DataFrame:
    """:func:`salted_join`, but a table that is measured to be small is broadcast and ``rows`` are neither sketched nor moved.

    For tables that are cheap to read, as they are read once more to be measured.
    """
    if fits_broadcast(table):
        return rows.join(F.broadcast(table), key, how)
    return salted_join(rows, table, key, spread, how, hot)


def lookup(rows: DataFrame, table: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    """Left join of wide ``rows`` to ``table`` (unique on ``key``).

    When the table, or the part of it the rows refer to, is measured to be small, it is broadcast and the rows stay
    where they are; otherwise the rows travel by key, hot keys salted.
    """
    if fits_broadcast(table):
        return rows.join(F.broadcast(table), key, "left")
    part = restrict(table, rows, [key])
    if fits_broadcast(part):
        return rows.join(F.broadcast(part), key, "left")
    return salted_join(rows, table, key, spread)


def earlier(
    rows: DataFrame,
    key: str,
    seq: str,
    chunk: Column,
    value: Column,
    fold: Callable[[Column], Column],
    merge: Callable[[Column, Column], Column],
    name: str,
) -> DataFrame:
    """Add ``name``: ``fold`` of ``value`` over the strictly earlier rows of the same key.

    ``merge`` combines two folded values; it must ignore a null on either side (``greatest``, ``least``). The rows lie by key
    and chunk already, so the carried values come to them and never pass the driver.
    """
    tagged = rows.withColumn("_chunk", chunk)
    before = Window.partitionBy(key, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.repartition(key, "_chunk").withColumn("_local", fold(value).over(before))
    chunks_before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        tagged.groupBy(key, "_chunk")
        .agg(fold(value).alias("_part"))
        .withColumn("_carry", fold(F.col("_part")).over(chunks_before))
        .where(F.col("_carry").isNotNull())
        .select(key, "_chunk", "_carry")
    )
    return (
        local.join(carried.hint("merge"), [key, "_chunk"], "left")
        .withColumn(name, merge(F.col("_local"), F.col("_carry")))
        .drop("_chunk", "_local", "_carry")
    )


def since_reset(
    rows: DataFrame,
    key: str,
    seq: str,
    chunk: Column,
    reset: Column,
    tail: dict[str, tuple[Callable[[Column], Column], Column, Callable[[Column], Column]]],
    whole: dict[str, tuple[Column, Callable[[Column], Column]]],
) -> DataFrame:
    """One row per key: ``tail`` folds the rows after the key's last ``reset`` row, ``whole`` all rows.

    A ``tail`` entry is ``(fold, row value, fold of partial results)``; a ``whole`` entry is
    ``(aggregate, fold of partial results)``. Both must be mergeable (sum, min, max).
    """
    tagged = rows.withColumn("_chunk", chunk).withColumn("_reset", F.coalesce(reset, F.lit(False)))
    in_chunk = Window.partitionBy(key, "_chunk")
    marked = tagged.repartition(key, "_chunk").withColumn(
        "_last", F.max(F.when(F.col("_reset"), F.col(seq))).over(in_chunk)
    )
    in_tail = F.col("_last").isNull() | (F.col(seq) > F.col("_last"))
    parts = marked.groupBy(key, "_chunk").agg(
        F.max("_reset").alias("_has_reset"),
        *[fold(F.when(in_tail, value)).alias(name) for name, (fold, value, _) in tail.items()],
        *[agg.alias(name) for name, (agg, _) in whole.items()],
    )
    ranked = parts.withColumn(
        "_from", F.max(F.when(F.col("_has_reset"), F.col("_chunk"))).over(Window.partitionBy(key))
    )
    live = F.col("_from").isNull() | (F.col("_chunk") >= F.col("_from"))
    return ranked.groupBy(key).agg(
        F.max("_has_reset").alias("has_reset"),
        *[refold(F.when(live, F.col(name))).alias(name) for name, (_, _, refold) in tail.items()],
        *[refold(F.col(name)).alias(name) for name, (_, refold) in whole.items()],
    )
