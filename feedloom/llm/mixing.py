"""Mixing sources to target weights by pivotal dependent rounding.

Every row should be taken ``target / source size`` times. The whole part is taken for certain; the fractional parts of two
rows of a source trade mass at random until one of them is 0 or 1, keeping the expected copies of each row and the words of
both together. The row left over meets the next one. Chunks of a source are rounded in parallel, and what is left over of
each chunk is rounded again in chunks, level by level, so that a source of any size ends with one open row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import small_side, stored

#: Weights of the sources in code point order, repeating; shares of the total; largest number of copies.
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.0
MAX_COPIES = 3
#: Rows rounded by one call, and left-over rows joined by one call of the reduction tree.
CHUNK_ROWS = 4096
_NEAR = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET,
                   most: int = MAX_COPIES) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of the table ``sizes`` (``source``, ``source_size``), a row per source.

    Sources share ``budget`` of all words by weight, in code point order with null last. A share above ``most`` times
    the source's size stops there and what is left is shared by weight among the others, until no share is above.
    """
    spark = sizes.sparkSession
    cap, order = F.lit(float(most)) * F.col("source_size"), F.asc_nulls_last("source")
    # A distributed rank: rows are numbered within range partitions, behind the rows of the partitions before.
    ranked = sizes.orderBy(order).rdd.zipWithIndex().map(lambda x: (x[0].source, x[0].source_size, x[1]))
    ranked = stored(spark.createDataFrame(ranked, sizes.select("source", "source_size").schema.add("rank", "long")))
    weight = F.array(*map(F.lit, weights))[(F.col("rank") % len(weights)).cast("int")]
    rows = ranked.withColumn("weight", weight)
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, capped = None, -1
    while True:  # every pass but the last stops at least one more source
        open_ = F.lit(True) if level is None else F.col("weight") * level < cap
        state = rows.agg(F.sum(F.when(open_, F.col("weight"))).alias("w"), F.sum(F.when(~open_, cap)).alias("c"),
                         F.count(F.when(~open_, 1)).alias("n")).first()
        if state.n == capped or not state.w:
            break
        capped, level = state.n, (total - (state.c or 0.0)) / state.w
    share = cap if level is None else F.least(cap, F.col("weight") * F.lit(level))
    return rows.select("source", "source_size", share.alias("target"))


def _trade(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> None:
    """Round ``p`` in place until one entry at most is between 0 and 1; the sum of ``size * p`` stays."""
    draws, held = rng.random(p.size), -1
    for i in range(p.size):
        if not _NEAR < p[i] < 1 - _NEAR:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        ratio = size[b] / size[a]
        up, down = min(1 - p[a], p[b] * ratio), min(p[a], (1 - p[b]) * ratio)
        if draws[i] * (up + down) < down:
            p[a], p[b] = p[a] + up, p[b] - up / ratio
        else:
            p[a], p[b] = p[a] - down, p[b] + down / ratio
        left = [k for k in (a, b) if _NEAR < p[k] < 1 - _NEAR]
        for k in (a, b):
            if k not in left:
                p[k] = round(p[k])
        held = left[0] if left else -1


def mix(rows: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """``rows`` (with ``key``, ``source`` and ``size``) joined to their source's target, with the words ``taken``.

    Reruns agree: draws come from the seed, the level and the chunk, rows of a chunk have a fixed order. Rows that agree
    in everything are rounded one by one. A null source is a source; a row without words is taken 0 words of.
    """
    spark = rows.sparkSession
    targets = small_side(targets, 64)
    known = targets.withColumnRenamed("source", "_source")
    all_rows = rows.join(known, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.least(F.lit(float(MAX_COPIES)), F.col("target") / F.greatest("source_size", F.lit(1)))
    counts = rows.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / CHUNK_ROWS)).alias("_chunks"))
    counts = small_side(stored(counts), 64).withColumnRenamed("source", "_source")
    work = (
        all_rows.join(counts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        .withColumn("_p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(F.lit(0.0)))
        .withColumn("_whole", F.floor(rate))
        .withColumn("_chunk", F.pmod(F.xxhash64(key, "size"), F.col("_chunks")))
    )
    level, done, layout = 0, [], work.schema

    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        # Large rows first: the row left open at the end is a small one.
        group = group.sort_values(["size", key], ascending=[False, True], kind="stable", na_position="last")
        name = f"{seed}/{level}/{group['source'].iloc[0]}/{group['_chunk'].iloc[0]}"
        rng = np.random.default_rng(np.frombuffer(name.encode(), np.uint8))
        p = group["_p"].to_numpy(dtype=float, copy=True)
        _trade(group["size"].to_numpy(dtype=float), p, rng)
        if group["_chunks"].iloc[0] <= 1:  # the last row of a source
            for i in np.flatnonzero((p > 0) & (p < 1)):
                p[i] = float(rng.random() < p[i])
        return group.assign(_p=p)

    while True:
        work = stored(work.groupBy("source", "_chunk").applyInPandas(rounded, layout))
        open_ = (F.col("_p") > 0) & (F.col("_p") < 1)
        done.append(work.where(~open_))
        if not work.where(open_).head(1):
            break
        level += 1
        work = (
            work.where(open_).withColumn("_chunk", F.floor(F.col("_chunk") / CHUNK_ROWS))
            .withColumn("_chunks", F.ceil(F.col("_chunks") / CHUNK_ROWS)).select(*layout.names)
        )
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    taken = F.col("size") * (F.col("_whole") + F.col("_p").cast("long"))
    return result.withColumn("taken", taken.cast("long")).drop("_p", "_whole", "_chunk", "_chunks")


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` of every row of ``docs``.

    The text is read once; everything after that moves ids, sources and sizes only. An empty table gives an empty one.
    """
    rows = stored(docs.select("doc_id", "source", words().alias("size")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    return mix(rows, targets, seed=seed).select("doc_id", "size", "source_size", "target", "taken")
