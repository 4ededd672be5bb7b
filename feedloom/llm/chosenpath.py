"""Near duplicates by a chosen-path set similarity join.

A document's set are its distinct word shingles. In each of ``TREES`` independent random trees a document goes from a node
to the child named by the smallest token of its set under the node's random order, so two documents stay together with
their Jaccard similarity as the chance of every step. A node of at most ``SMALL`` documents is compared exhaustively;
larger ones branch on, and at the last level into two children each, which keeps alike documents from drifting apart.

Nodes at the last level that are still large hold documents which are alike, or a rare accident. There every document is
compared with the node's first one. Where that does not join the whole node into one component, all its documents are
compared with each other, block by block. So no pair in a node is passed over unless a chain of links joins it already.

Pairs are judged where they meet by sizes and one-bit sketches, then by full sketches (both with six standard deviations
of slack), and confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import mix, slices, small_side, stored, word_hashes

WIDTH = 5
TREES = 24
#: Levels of a tree; from level ``FORK`` on each path has ``BRANCHES`` continuations. Tokens are 16 bits of a rank, so the
#: first nodes are those of level ``ROOT``: a name of 48 bits, which documents hardly share by accident.
LEVELS, ROOT, FORK, BRANCHES = 5, 3, 4, 2
SMALL = 24
#: Documents of a large node that are compared with as many others by one task.
BLOCK = 512
_COLUMNS = TREES * (FORK + BRANCHES * (LEVELS - FORK))
_FACTORS = mix(np.arange(1, _COLUMNS + 1)) | np.uint64(1)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text, already lower-cased.

    A text of fewer words has its whole sequence as one shingle, one without words none.
    """
    words, counts = word_hashes(texts)
    factors = mix(np.arange(101, 101 + width)) | np.uint64(1)
    rolled = np.zeros(max(words.size - width + 1, 0), np.uint64)
    for i in range(width):
        rolled += words[i : i + rolled.size] * factors[i]
    rolled = mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        else:
            short = (words[at : at + n] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix(np.array([short] if n else [], np.uint64)))
        at += n
    return out


def minwise(tokens: np.ndarray, block: int = 4096) -> np.ndarray:
    """For each random order the smallest token, as 16 bits of its rank in that order."""
    low = np.full(_COLUMNS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, tokens.size, block):
        low = np.minimum(low, (tokens[at : at + block, None] * _FACTORS).min(0))
    return (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def _lower(text: str | None) -> bytes:
    return (text or "").encode().lower()  # of bytes: A-Z only


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``id``, ``n`` (set size), ``digest`` (of the set), ``path`` (minwise tokens) and ``bits`` (of 128 of them) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            sets = shingle_sets([_lower(t) for t in part.column("text").to_pylist()], width)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            paths = [minwise(s) for s in sets]
            bits = np.stack([np.packbits((p[:128] & 1).astype(bool)) for p in paths]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([s.size for s in sets], pa.int64()), pa.array(digest),
                 pa.array([p.tobytes() if s.size else None for p, s in zip(paths, sets, strict=True)], pa.binary()),
                 pa.array(bits[:, 0]), pa.array(bits[:, 1])], ["id", "n", "digest", "path", "bits", "more"])

    return docs.mapInArrow(rows, "id long, n long, digest binary, path binary, bits long, more long")


def _keys(level: int) -> list:
    """Node keys of a row at a level from its ``path``: the tokens chosen from the root on."""
    out, width = [], FORK + BRANCHES * (LEVELS - FORK)
    for tree in range(TREES):
        trunk = F.substring("path", 2 * tree * width + 1, 2 * min(level, FORK))
        if level <= FORK:
            out.append(F.xxhash64(F.lit(tree), trunk))
            continue
        for branch in range(BRANCHES):
            at = tree * width + FORK + branch * (LEVELS - FORK)
            out.append(F.xxhash64(F.lit(tree), F.lit(branch), trunk, F.substring("path", 2 * at + 1, 2 * (level - FORK))))
    return out


def _nodes(reps: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Members (``key``, ``id``) of the small nodes of each level, and of the large ones of the last."""
    rows = reps.select("id", F.posexplode(F.array(*_keys(ROOT))).alias("at", "key"))
    small = []
    for level in range(ROOT, LEVELS + 1):
        counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        members = stored(rows.join(counts, "key"))
        small.append(members.where(F.col("n") <= SMALL).select("key", "id"))
        large = members.where(F.col("n") > SMALL)
        if level == LEVELS or not large.head(1):
            return small, large.select("key", "id")
        # The next step of the same path; at the fork each path goes on in all branches.
        fork = BRANCHES if level == FORK else 1
        steps = large.select("id", F.explode(F.array(*(F.col("at") * fork + i for i in range(fork)))).alias("at"))
        following = reps.select("id", F.array(*_keys(level + 1)).alias("keys"))
        # The key of a level starts with the choices of the levels above, so children of different nodes never meet.
        rows = stored(steps.join(following, "id").select("id", "at", F.element_at("keys", F.col("at") + 1).alias("key")))
    raise AssertionError


def _side(reps: DataFrame, name: str, other: str) -> DataFrame:
    """Columns that :func:`_close` looks at, with the id called ``name``."""
    return reps.select(F.col("id").alias(name), *(F.col(c).alias(f"{c}_{other}") for c in ("n", "bits", "more")))


def _close(percent: int) -> Column:
    """Whether sizes and one-bit sketches of two rows allow the similarity: the bits of alike sets differ rarely."""
    miss = (1 - percent / 100) / 2
    most = math.ceil(128 * miss + 6 * math.sqrt(128 * miss * (1 - miss)))
    apart = F.bit_count(F.col("bits_x").bitwiseXOR(F.col("bits_y"))) + F.bit_count(F.col("more_x").bitwiseXOR(F.col("more_y")))
    return (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent) & (apart <= most)


def _alike(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a`` < ``b``) whose full sketches allow the similarity."""
    t = percent / 100
    least = math.floor(_COLUMNS * t - 6 * math.sqrt(_COLUMNS * t * (1 - t)))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, _COLUMNS) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    left, right = reps.select(F.col("id").alias("a"), F.col("path").alias("x")), reps.select(F.col("id").alias("b"), F.col("path").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(judged, "a long, b long")


def _full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id`` and the whole set (``tokens``) of the rows named by the stored table ``ids``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            sets = shingle_sets([_lower(t) for t in part.column("text").to_pylist()], width)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "tokens"])

    return stored(docs.join(small_side(ids, 24), "id", "left_semi").mapInArrow(rows, "id long, tokens binary"))


def _links(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs confirmed on the full sets: 100 * intersection >= percent * union."""
    pairs = stored(_alike(pairs, reps, percent))
    full = _full_sets(docs, stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), width)

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "x", 16 << 20):
            keep = []
            for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= percent * (x.size + y.size - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = full.toDF("a", "x"), full.toDF("b", "y")
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(confirmed, "a long, b long"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, from products of 0/1 matrices."""
    owner = np.repeat(np.arange(len(left) + len(right)), [s.size for s in (*left, *right)])
    tokens, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    shared = np.bincount(at, minlength=tokens.size) > 1
    place = np.where(shared, np.cumsum(shared) - 1, -1)[at]
    owner, place = owner[place >= 0], place[place >= 0]
    out = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int(shared.sum()), columns):
        here = (place >= begin) & (place < begin + columns)
        grid = np.zeros((len(left) + len(right), columns), np.float32)
        grid[owner[here], place[here] - begin] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out


def _group_links(members: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Links between the components (``root``) in each group of members (``group``, ``id``), whole block by whole block.

    A pair of blocks is one task's work and gives its links alone, so pairs that are no links are never rows.
    """
    full = _full_sets(docs, stored(members.select("id").distinct()), width)
    blocks = members.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = members.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.join(full, "id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("group", "id", "root", "tokens", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf["block"] == pdf["lo"]], pdf[pdf["block"] == pdf["hi"]]
        x, y = ([np.frombuffer(t, np.uint64) for t in side["tokens"]] for side in (one, two))
        if not x or not y:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        both = overlaps(x, y)
        union = np.array([s.size for s in x])[:, None] + np.array([s.size for s in y]) - both
        apart = one["root"].to_numpy()[:, None] != two["root"].to_numpy()
        i, j = np.nonzero((100 * both.astype(np.int64) >= percent * union) & apart)
        a, b = one["id"].to_numpy()[i], two["id"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return stored(rows.groupBy("group", "lo", "hi").applyInPandas(compared, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``root``, the smallest id that a chain of links (``a``, ``b``) reaches, for every linked id but the roots.

    Alternates large and small star steps until the edges stay; each step is a grouped minimum and a join.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def state(frame: DataFrame):
        return frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large.where("u <> v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Rows are linked from ``percent`` percent of Jaccard similarity on; a component is named by its smallest id and its row
    is kept. Equal sets count as one document until the end, so copies cost one row each. Rows without words are linked
    with nothing. Rows sharing an id are one document; a null id is linked with nothing, has no component and is kept.
    """
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    every = stored(_sets(source, width))
    sets = every.where("n > 0 AND id IS NOT NULL")
    classes = stored(sets.groupBy("digest").agg(F.min("id").alias("first")))
    reps = stored(
        sets.join(classes, (F.col("id") == F.col("first")) & (sets.digest == classes.digest), "left_semi")
        .select("id", "n", "path", "bits", "more").dropDuplicates(["id"])
    )
    small, large = _nodes(reps)
    x, y, close = _side(reps, "a", "x"), _side(reps, "b", "y"), _close(percent)
    pairs = None
    for members in small:
        mine, other = (members.withColumnRenamed("id", side.columns[0]).join(side, side.columns[0]) for side in (x, y))
        found = mine.join(other, "key").where((F.col("a") < F.col("b")) & close).select("a", "b")
        pairs = found if pairs is None else pairs.unionByName(found)
    first = large.groupBy("key").agg(F.min("id").alias("a"))
    star = large.withColumnRenamed("id", "b").join(first, "key").where("a < b").select("a", "b").distinct()
    pairs = pairs.unionByName(star.join(x, "a").join(y, "b").where(close).select("a", "b"))
    links = _links(pairs.distinct(), source, reps, percent, width)
    roots = stored(components(links))
    if large.head(1):
        # Large nodes with the same first document hold much the same documents: compared together, once.
        members = large.join(first, "key").select(F.col("a").alias("group"), "id").distinct()
        placed = stored(members.join(roots, "id", "left").select("group", "id", F.coalesce("root", "id").alias("root")))
        open_ = placed.groupBy("group").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("group")
        more = _group_links(stored(placed.join(open_, "group")), source, percent, width)
        if more.head(1):
            roots = stored(components(links.unionByName(more)))
    # Classes whose first rows are linked share a root; the smallest id of a component is the smallest of its classes.
    named = classes.join(roots.withColumnRenamed("id", "first"), "first", "left")
    named = named.select("digest", F.coalesce("root", "first").alias("root"))
    out = every.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("root"))).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


#: The query over ``documents`` at 85 percent, from all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
spoken AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM words),
runs AS (
    SELECT doc_id, i, n, concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d) AS shingle
    FROM spoken WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
distinct_runs AS (SELECT DISTINCT doc_id, shingle FROM runs WHERE i = 1 OR i <= n - 4),
sizes AS (SELECT doc_id, count(*) AS size FROM distinct_runs GROUP BY doc_id),
flat AS (SELECT doc_id, size, shingle FROM distinct_runs JOIN sizes USING (doc_id)),
shared AS (SELECT shingle, row_number() OVER () AS id FROM flat GROUP BY shingle HAVING count(*) > 1),
said AS (SELECT doc_id, size, id FROM flat JOIN shared USING (shingle)),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM said a JOIN said b ON a.id = b.id AND a.doc_id < b.doc_id AND 100 * least(a.size, b.size) >= 85 * greatest(a.size, b.size)
    GROUP BY a.doc_id, b.doc_id, a.size, b.size HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, y FROM reach r JOIN links ON x = other)
SELECT doc_id, coalesce(size, 0) AS n_shingles, least_id AS component_id, doc_id = least_id AS kept
FROM (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""
