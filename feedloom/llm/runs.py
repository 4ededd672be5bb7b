"""Periodic runs of words, found with an enhanced suffix array.

A run is a stretch of words that repeats with its smallest period, as often as asked for, and that no neighbouring word
extends. Of every stretch with period ``q`` the last square, two periods up to its end, is *branching*: its start ``i`` and
``i + q`` are suffixes which share exactly ``q`` words, so they lie in different children of the LCP interval of depth
``q``. The test is therefore: for every LCP interval, all suffixes ``i`` of all children but the largest look up whether
the suffixes ``i + depth`` and ``i - depth`` are in the same interval but another child, by one look into the inverse
suffix array each. A suffix is in a smaller child at most log2(n) times. Intervals are ranges of the sorted suffixes that
fall out of one pass over the LCP values; no tree is made.

Squares found are rotated to the left as far as the period holds, squares of a multiple of a period are dropped.

Suffixes are sorted by prefix doubling, for many documents at once: words of different documents are different symbols, and
every document ends with a symbol of its own, so nothing reaches from one document into another. Only suffixes that are
still equal are sorted again. A document is worked on whole by one task, in memory of about 4 * log2(longest repeat) bytes
a word beside the text; documents are independent of each other, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import CRC_SQL, slices

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
#: Words sorted together, and suffixes tested together.
BATCH_WORDS = 1 << 16
BATCH_TESTS = 1 << 18
_WORD = r"[^\x20\x09-\x0D]+"


def sorted_suffixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse, LCP values (of a suffix and the one sorted before it) and ranks by the first 2**k symbols.

    The last symbol of every document must occur once.
    """
    n = symbols.size
    order = np.argsort(symbols, kind="stable")
    ahead = symbols[order]
    first = np.ones(n, bool)
    first[1:] = ahead[1:] != ahead[:-1]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, lcp, h = [rank.copy()], np.zeros(n, np.int32), 1
    tied = ~first
    slots = np.flatnonzero(tied | np.append(tied[1:], False))
    while slots.size:
        at = order[slots]
        group = rank[at].astype(np.int64)
        key = group * (n + 1) + rank[at + h]  # a tied suffix has h symbols and one behind them
        by = np.argsort(key, kind="stable")
        at, key, group = at[by], key[by], group[by]
        order[slots] = at
        first = np.ones(slots.size, bool)
        first[1:] = key[1:] != key[:-1]
        # Neighbours parted now share between h and 2 * h - 1 symbols; the ranks of shorter prefixes tell how many.
        parted = np.flatnonzero(first[1:] & (group[1:] == group[:-1])) + 1
        a, b = at[parted - 1] + h, at[parted] + h
        common = np.full(parted.size, h, np.int32)
        for k in range(len(levels) - 2, -1, -1):
            step = (levels[k][a] == levels[k][b]) * (1 << k)
            a, b, common = a + step, b + step, common + step
        lcp[slots[parted]] = common
        rank[at] = np.maximum.accumulate(np.where(first, slots, 0))
        levels.append(rank.copy())
        h *= 2
        tied = ~first
        slots = slots[tied | np.append(tied[1:], False)]
    return order, rank, lcp, levels


def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Depth, first and last place of the LCP intervals with ``least`` suffixes or more; owner and place of their borders.

    A border is a place whose LCP value is the interval's depth: there a new child begins.
    """
    inside = lcp > 0
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edge[0::2], edge[1::2]
    long = end - begin >= least - 1
    begin, end = begin[long], end[long]
    depth: list[int] = []
    low: list[int] = []
    high: list[int] = []
    owner: list[int] = []
    place: list[int] = []
    for x, y in zip(begin.tolist(), end.tolist(), strict=True):
        open_: list[int] = []
        for s, value in enumerate(lcp[x:y].tolist(), x):
            left = s - 1
            while open_ and depth[open_[-1]] > value:
                left = low[open_[-1]]
                high[open_.pop()] = s - 1
            if not open_ or depth[open_[-1]] < value:
                open_.append(len(depth))
                depth.append(value), low.append(left), high.append(0)
            owner.append(open_[-1])
            place.append(s)
        for i in open_:
            high[i] = y - 1
    parts = [np.array(v, np.int64) for v in (depth, low, high, owner, place)]
    large = parts[2] - parts[1] >= least - 1
    number = np.cumsum(large) - 1
    mine = large[parts[3]] if parts[3].size else np.zeros(0, bool)
    return (*(p[large] for p in parts[:3]), number[parts[3][mine]], parts[4][mine])


def branching_squares(order: np.ndarray, rank: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Start and period of the branching squares whose period occurs in ``least`` places or more, as two columns."""
    depth, low, high, owner, place = lcp_intervals(lcp, least)
    owner = np.concatenate([np.arange(depth.size), owner])
    start = np.concatenate([low, place])
    by = np.lexsort([start, owner])
    owner, start = owner[by], start[by]
    last = np.append(owner[1:] != owner[:-1], True) if owner.size else np.zeros(0, bool)
    end = np.where(last, high[owner] + 1, np.append(start[1:], 0)) if owner.size else start
    # All children but one of the largest.
    by = np.lexsort([end - start, owner])
    small = by[np.append(owner[by][1:] == owner[by][:-1], False)] if owner.size else by
    size = end[small] - start[small]
    upto = np.cumsum(size)
    found = [np.zeros((0, 2), np.int64)]
    at = 0
    while at < small.size:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH_TESTS, "right")))
        some, n = small[at:to], size[at:to]
        child = np.repeat(some, n)
        slot = start[child] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        suffix, q = order[slot], depth[owner[child]]
        for shift, begin in ((q, suffix), (-q, suffix - q)):
            other = rank[np.maximum(suffix + shift, 0)]
            hit = (begin >= 0) & (other >= low[owner[child]]) & (other <= high[owner[child]])
            hit &= (other < start[child]) | (other >= end[child])
            found.append(np.stack([begin[hit], q[hit]], 1))
        at = to
    return np.unique(np.concatenate(found), axis=0)


def find_runs(documents: list[np.ndarray], least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period), sorted, of each document given as an array of word numbers.

    A run has ``least`` words and ``exponent`` (2 at least) times its period or more.
    """
    if exponent < 2:
        raise ValueError("a run holds its period at least twice")
    sizes = np.array([d.size for d in documents])
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not sizes.sum():
        return out
    begin = np.cumsum(sizes + 1) - sizes - 1
    width = max(int(d.max()) + 1 for d in documents if d.size) + 1
    symbols = np.concatenate([np.append(d, width - 1) + i * width for i, d in enumerate(documents)])
    order, rank, lcp, levels = sorted_suffixes(symbols)
    squares = branching_squares(order, rank, lcp, exponent)
    start, q = squares[:, 0], squares[:, 1]
    end = start + 2 * q
    # Rotate to the left while the period holds; the ranks of prefixes compare 2**k words at once.
    for k in range(len(levels) - 1, -1, -1):
        back = np.maximum(start - (1 << k), 0)
        start = np.where((start >= 1 << k) & (levels[k][back] == levels[k][back + q]), back, start)
    long = end - start >= np.maximum(least, exponent * q)
    known: dict[int, list[tuple[int, int]]] = {}
    for s, e, period in sorted(zip(start[long].tolist(), end[long].tolist(), q[long].tolist(), strict=True), key=lambda r: r[2]):
        # A square of a multiple lies in the run of its root and ends with it.
        if any(period % root == 0 and at <= e - 2 * period for at, root in known.get(e, ())):
            continue
        known.setdefault(e, []).append((s, period))
        i = int(np.searchsorted(begin, s, "right")) - 1
        out[i].append((s - int(begin[i]), e - s, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for the words that no run has behind its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (structs of ``start``, ``length``, ``period`` in words) and ``collapsed`` of every row.

    ``collapsed`` is the text, as bytes, with each run cut to its first period and one space between words. Words are
    separated by ASCII white space. A null or empty text has no words, no runs and an empty collapsed text; a very long one
    is worked on whole. Runs of one document are in the order of start and period; several may overlap. Repeated rows, and
    rows with a null id, stay rows of their own. Other columns are not read. An empty table gives no rows.
    """
    run = "array<struct<start:long,length:long,period:long>>"
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body"):
            words = [(t or b"").split() for t in part.column("body").to_pylist()]  # of bytes: ASCII white space only
            numbered = []
            for said in words:
                index: dict[bytes, int] = {}
                numbered.append(np.array([index.setdefault(w, len(index)) for w in said], np.int64))
            runs: list[list[tuple[int, int, int]]] = []
            upto = np.cumsum([d.size for d in numbered])
            while (at := len(runs)) < len(words):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH_WORDS, "right")))
                runs += find_runs(numbered[at:to], least, exponent)
            kept = [
                b" ".join(said if not found else [w for w, k in zip(said, kept_words(len(said), found).tolist(), strict=True) if k])
                for said, found in zip(words, runs, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(said) for said in words], pa.int64()),
                 pa.array([[{"start": a, "length": b, "period": c} for a, b, c in found] for found in runs], arrow),
                 pa.array(kept, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    return source.mapInArrow(rows, f"doc_id long, n_words long, runs {run}, collapsed binary")


def with_periods(key: str = "doc_id", text: str = "text") -> Column:
    """The text, in one document of ten (by a hash of the id) with its words from a place on repeating with a period."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    period = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    block = F.slice(words, a + 1, period)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / period).cast("int"))), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(F.col(text))


def run_report(docs: DataFrame) -> DataFrame:
    """Digests of :func:`periodic_runs` over the texts of :func:`with_periods`, one row for every row of ``docs``."""
    found = periodic_runs(docs.select("doc_id", with_periods().alias("text")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    named = found.withColumn("longest", longest)
    length = -F.col("longest.l")
    return named.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.s").alias("start"), length.alias("length"),
        F.col("longest.p").alias("period"), F.expr("1000 * -longest.l div longest.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The query over ``documents``, from all pairs of equal words a candidate period apart.
SQL = rf"""
WITH crc_keys AS (SELECT CAST(doc_id AS VARCHAR) AS key FROM documents),
{CRC_SQL},
whole AS (
    SELECT doc_id, h, h // 10 AS g, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
    FROM documents JOIN crc ON key = CAST(doc_id AS VARCHAR)),
periodic AS (
    SELECT doc_id, w, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) ELSE len(w) END AS a,
        CASE WHEN h % 10 = 0 AND len(w) > 0 THEN 1 + (len(w) - g % len(w)) // (3 + g % 8) ELSE 1 END AS p FROM whole),
source AS (SELECT doc_id, a, p, unnest(range(len(w))) AS i FROM periodic),
said AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM periodic),
words AS MATERIALIZED (
    SELECT s.doc_id, s.i, word FROM source s JOIN said o ON o.doc_id = s.doc_id AND o.i = CASE WHEN s.i < a THEN s.i ELSE a + (s.i - a) % p END),
-- A run of four periods or more has equal words at three neighbouring multiples of its period.
places AS (
    SELECT doc_id, q, unnest(range(0, n - 2 * q, q)) AS i FROM (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) // 4 + 1)) AS q FROM periodic)),
steps AS MATERIALIZED (SELECT doc_id, q, i, word FROM places JOIN words USING (doc_id, i)),
periods AS (
    SELECT DISTINCT a.doc_id, a.q FROM steps a
    JOIN words b ON b.doc_id = a.doc_id AND b.i = a.i + a.q AND b.word = a.word
    JOIN words c ON c.doc_id = a.doc_id AND c.i = a.i + 2 * a.q AND c.word = a.word),
equal AS (
    SELECT a.doc_id, q, a.i, a.i - row_number() OVER (PARTITION BY a.doc_id, q ORDER BY a.i) AS stretch
    FROM periods p JOIN words a ON a.doc_id = p.doc_id JOIN words b ON b.doc_id = a.doc_id AND b.i = a.i + q AND b.word = a.word),
stretches AS (
    SELECT doc_id, q, min(i) AS start, CAST(count(*) + q AS BIGINT) AS length FROM equal GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
    SELECT * FROM stretches s WHERE NOT EXISTS (
        SELECT 1 FROM stretches t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', q, chr(10)), '' ORDER BY start, q) AS list,
        min(struct_pack(less := -length, start := start, q := q)) AS best FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON r.doc_id = w.doc_id AND w.i >= r.start + r.q AND w.i < r.start + r.length),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, -best.less AS length, best.q AS period,
    CAST(1000 * -best.less // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
