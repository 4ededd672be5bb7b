"""Benchmark decontamination with a hash set of normalised test n-grams, in DataFrame operations only.

A window is a run of ``window`` words of a benchmark item, or all words of a shorter item. Each document row makes the
hashes of its own windows and looks them up in a bitmap of the benchmark's hashes; what passes is joined to the hash set
and compared word by word. Rows without a hit never leave their task but for a narrow row of counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import small_side, stored

WINDOW = 13
#: Words of a text whose A-Z were not lowered yet.
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of the bitmap: slots per window, and bytes at most, whatever the benchmark's size.
_SLOTS, _BITMAP_BYTES = 16, 1 << 22


def _words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({_WORDS})"), 1), F.array().cast("array<string>"))


def _coarse(words: Column) -> Column:
    """Word hashes blind to any letter case: equal for words that are equal once A-Z are lowered."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _hash_of(hashes: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.slice(hashes, at, n), F.lit(n))


def _exact(words: Column) -> Column:
    return F.translate(F.array_join(words, " "), _UPPER, _LOWER)


def _starts(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``window`` (its words), ``n`` (their number), ``hash`` and the sorted ``items`` that hold it, a row per window.

    Items without words have no window; windows of an item with a null id are hit but name no item.
    """
    rows = items.select(F.col(key).cast("string").alias("item"), _words(text).alias("words")).where(F.size("words") > 0)
    n = F.least(F.lit(window), F.size("words"))
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    cut = F.transform(starts, lambda i: F.struct(_exact(F.slice("words", i, n)).alias("window"), F.xxhash64(F.slice("hashes", i, n), n).alias("hash")))
    found = rows.withColumn("hashes", _coarse(F.col("words"))).select("item", n.alias("n"), F.explode(cut).alias("w"))
    return found.groupBy("w.window", "n", "w.hash").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _bitmap(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test whether a hash may be one of column ``hash``: a literal with a byte per slot, 1 KiB to 4 MiB of them."""
    size = min(_BITMAP_BYTES, max(1024, 1 << math.ceil(math.log2(max(hashes.count(), 1) * _SLOTS))))
    data = bytearray(size)
    for r in hashes.select(F.col("hash").bitwiseAND(size - 1).cast("int").alias("at")).distinct().collect():
        data[r["at"]] = 1
    slots, one = F.lit(bytes(data)), F.lit(b"\x01")
    return lambda h: F.substring(slots, h.bitwiseAND(size - 1).cast("int") + 1, F.lit(1)) == one


def find_hits(docs: DataFrame, windows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with ``n_words`` and ``hits``: an array of (``at``, ``n``, ``items``), may be null.

    ``windows`` is a stored table of :func:`benchmark_windows`.
    """
    window_known = _bitmap(windows)
    word_known = _bitmap(windows.select(F.explode(_coarse(F.split("window", " "))).alias("hash")).distinct())
    lengths = [r.n for r in windows.select("n").distinct().collect()]  # window lengths: 1 to 13
    rows = docs.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], _words(text).alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.withColumn("hashes", _coarse(F.col("words")))

    def passing(n: int) -> Column:
        # A few words of the window are looked up before all of them are hashed.
        probes = sorted({0, n // 4, n // 2, 3 * n // 4, n - 1})

        def known(i: Column) -> Column:
            hashes = F.col("hashes")
            words = [word_known(F.get(hashes, i + (p - 1))) for p in probes]
            return reduce(Column.__and__, [*words, window_known(_hash_of(hashes, i, n))])

        return F.transform(F.filter(_starts(F.col("hashes"), n), known), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), _hash_of(F.col("hashes"), i, n).alias("hash")))

    candidates = F.concat(*(passing(n) for n in lengths)) if lengths else F.array().cast("array<struct<at:int,n:int,hash:bigint>>")
    worded = F.transform(candidates, lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), x["hash"].alias("hash"), _exact(F.slice("words", x["at"], x["n"])).alias("window")))
    ids = [f"k{i}" for i in range(len(keep))]
    found = rows.select("row", *ids, F.size("words").cast("long").alias("n_words"), F.explode_outer(worded).alias("c"))
    found = found.select("row", *ids, "n_words", "c.*")
    hit = found.join(small_side(windows, 512), ["hash", "n", "window"], "left")
    hits = F.collect_list(F.when(F.col("items").isNotNull(), F.struct("at", "n", "items")))
    # The row number makes a key of its own for each row; all of a group's rows come from one document.
    out = hit.groupBy("row", "n_words", *ids).agg(hits.alias("hits"))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "hits")


def covered(hits: Column) -> Column:
    """Number of words inside any of the hits."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["at"].alias("a"), (h["at"] + h["n"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("upto"))
    return F.aggregate(
        spans, zero,
        lambda acc, s: F.struct((acc["total"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["upto"]))).alias("total"),
                                F.greatest(acc["upto"], s["b"]).alias("upto")),
        lambda acc: acc["total"],
    )


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` of every row, behind columns ``keep``.

    A word is hit inside any occurrence of a window; a document is contaminated if at least a twentieth of its words,
    and one at least, are hit. A null text has no words. Rows that are repeated stay repeated. Without items nothing is hit.
    """
    windows = stored(benchmark_windows(items))
    found = find_hits(docs, windows, keep or ["doc_id"])
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    return found.withColumn("n_hit", covered(F.col("hits"))).withColumn("_names", names).select(
        *(keep or ["doc_id"]), "n_words", "n_hit", F.size("_names").cast("long").alias("n_items"),
        F.sha2(F.array_join("_names", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns; found ones are told by id and text hash."""
    print_ = F.xxhash64(text)
    found = contamination(docs.select(F.col(key).alias("_id"), print_.alias("_print"), F.col(text).alias("text")), items, ["_id", "_print"])
    found = stored(found.where("contaminated").select("_id", "_print").distinct())
    same = docs[key].eqNullSafe(found["_id"]) & (print_ == found["_print"])
    return docs.join(small_side(found, 64), same, "left_anti")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
i AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
h AS (
  SELECT DISTINCT r, p, q.n, item
  FROM (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)) q
  JOIN i ON q.win = i.win AND q.n = i.n),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)
"""
