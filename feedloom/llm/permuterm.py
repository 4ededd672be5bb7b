"""Spelling variants by permuterm rotations.

A word with a terminator behind it is rotated to all its places. The rotation that begins behind the character in place
``i`` ends with that character: without it, it is the *gap* ``after, terminator, before``, and every word that has some
character in this gap has a rotation which begins with the gap. So the words which differ from each other in one character
are a prefix range of the sorted rotations, one character longer than the gap; and a rotation that is the gap itself
belongs to the word without the character. A scan over the sorted range of a gap sees all of them.

A range holds one word per character of the alphabet. Still no pairs are made: each word takes from its range the number of
its neighbours there and the most frequent one. A pair that differs by a replacement meets in one gap. One that differs by an
insertion meets in one gap for each equal character beside the inserted one; the first of them counts.

Gaps beyond :data:`LONG_GAP` characters are named by two digests, of what is before and after, which are made step by step
along the word: a word of length ``n`` then costs ``n`` steps, not ``n`` copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import CRC_SQL, stored

TERMINATOR = "\x00"
LONG_GAP = 64
#: Occurrences that the form of a word needs for each of the word's own.
RATIO = 5
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: Rotations in one Arrow batch.
BATCH = 1 << 14


def _digests(text: str) -> list[str]:
    """Digest of every prefix of ``text``."""
    state, out = hashlib.blake2b(digest_size=16), []
    for c in ("", *text):
        state.update(c.encode("utf-8", "surrogatepass"))
        out.append(state.hexdigest())
    return out


def rotations(word: str) -> Iterator[tuple[str, str, bool]]:
    """Gap, last character and whether it differs from the one before it, of the rotations of a word.

    Every rotation is also a gap as a whole: then the character is empty.
    """
    n = len(word)
    before, after = (_digests(word), _digests(word[::-1])[::-1]) if n > LONG_GAP or TERMINATOR in word else ([], [])

    def gap(i: int, j: int) -> str:
        """Name of what is left of the word without ``word[i:j]``; a short one holds the terminator once."""
        if n - (j - i) <= LONG_GAP and TERMINATOR not in word[:i] + word[j:]:
            return word[j:] + TERMINATOR + word[:i]
        return TERMINATOR + TERMINATOR + before[i] + after[j]

    for i in range(n + 1):
        if i < n:
            yield gap(i, i + 1), word[i], i == 0 or word[i - 1] != word[i]
        yield gap(i, i), "", False


def rotated(words: DataFrame) -> DataFrame:
    """``gap``, ``mark``, ``leads``, ``word`` and ``n`` of all rotations of the words (``word``, ``n``)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gap", "mark", "leads", "word", "n"]
        queue: list[tuple] = []
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for gap, mark, leads in rotations(word):
                    queue.append((gap, mark, leads, word, n))
                    if len(queue) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*queue, strict=True)], names)
                        queue = []
        if queue:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*queue, strict=True)], names)

    return words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(rows, "gap string, mark string, leads boolean, word string, n long")


def neighbours(words: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and ``near`` (``less``: minus its count, ``word``) for words with a neighbour.

    ``words`` are distinct (``word``, ``n``). ``near`` is the most frequent neighbour, the smallest one of equals.
    """
    item = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    ranged = rotated(words).withColumn("fills", F.col("mark") != "").withColumn("item", item)
    group = Window.partitionBy("gap")
    # Words that fill the gap first, the most frequent ones before others.
    scan = group.orderBy(F.col("fills").desc(), "item").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = F.when(F.col("fills"), F.col("item"))
    seen = ranged.select(
        "word", "item", "fills", "leads",
        F.nth_value(filling, 1).over(scan).alias("first"),
        F.nth_value(filling, 2).over(scan).alias("second"),
        F.count(filling).over(scan).alias("n_fill"),
        F.min(F.when(F.col("leads"), F.col("item"))).over(scan).alias("first_lead"),
        F.count_if("leads").over(scan).alias("n_lead"),
        F.max(F.when(~F.col("fills"), F.col("item"))).over(scan).alias("bare"),
    )
    other = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    without = F.when(F.col("leads"), F.col("bare"))
    near = F.when(F.col("fills"), F.least(other, without)).otherwise(F.col("first_lead"))
    n_near = F.when(F.col("fills"), F.col("n_fill") - 1 + without.isNotNull().cast("long")).otherwise(F.col("n_lead"))
    found = seen.select("word", near.alias("near"), n_near.alias("n_near")).where("n_near > 0")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: the end of its chain of forms (``word``, ``form``), by pointer doubling.

    Every form is more frequent than its word by a constant factor, so chains have fewer than 64 steps: at most 6 rounds.
    """
    links = forms.select("word", F.col("form").alias("root"), F.lit(False).alias("ended"))
    while not (links := stored(links)).where("not ended").isEmpty():
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("ended").alias("last"))
        links = links.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), (F.col("next").isNull() | F.col("last")).alias("ended")
        )
    return links.select("word", "root")


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of distinct words with their counts (``word``, ``n``).

    Two words are near if one inserted, deleted or replaced code point leads from one to the other. The form of a word is
    its near word with the largest count, the smallest one (by code points) of equals, if that count is ``ratio`` times the
    word's own or more; ``root`` is the end of the chain of forms, the word itself if it has no form. ``ratio`` is 2 at
    least, so chains end. Null words are left out; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its words")
    words = stored(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    joined = words.join(neighbours(words), "word", "left")
    common = F.coalesce(-F.col("near.less") >= ratio * F.col("n"), F.lit(False))
    named = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("near.word")).alias("form"), F.when(common, -F.col("near.less")).alias("form_n"),
    ))
    ends = roots(named.where("form IS NOT NULL"))
    return named.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def misspelt(word: Column, key: str = "doc_id") -> Column:
    """The word, with one code point missing in one word of 199 by a hash of id and word."""
    h = F.crc32(F.concat(F.col(key).cast("string"), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % 199 == 0, cut).otherwise(word)


def corpus_words(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of the words (runs of letters up to U+00FF, A-Z lower-cased, see :func:`misspelt`) of all texts
    with ``least`` code points and ``count`` occurrences or more.

    A null text has no words, a null id leaves its words as they are; repeated rows count again. Counts are added up in
    each task before words move, so a word that a third of the corpus consists of moves once per task.
    """
    # Shorter runs can't become long enough, so they are passed over; longer ones match as a whole.
    runs = F.regexp_extract_all(text, F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))
    said = docs.select(F.col(key), F.explode(runs).alias("run")).select(key, F.translate("run", _UPPER, _LOWER).alias("run"))
    said = said.select(misspelt(F.col("run"), key).alias("word")).where(F.length("word") >= least)
    return said.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


#: The query over ``documents``, from all pairs of words that share a gap.
SQL = rf"""
WITH RECURSIVE said AS (
    SELECT doc_id, run, count(*) AS times FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{6,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM documents) GROUP BY ALL),
crc_keys AS (SELECT DISTINCT concat(doc_id, ':', run) AS key FROM said),
{CRC_SQL},
hashed AS (SELECT run, times, h FROM said JOIN crc ON key = concat(doc_id, ':', run)),
words AS (
    SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
        SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
-- Two words are near if one is the other without a character, or both are the same without the character in one place.
gaps AS (
    SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
    SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON w.word = g.rest
    UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON w.word = g.rest),
best AS (
    SELECT word, count(*) AS n_near, min(struct_pack(less := -n, code := encode(other))) AS top FROM pairs GROUP BY word),
forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN -top.less >= 5 * w.n THEN decode(top.code) END AS form, CASE WHEN -top.less >= 5 * w.n THEN -top.less END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word),
chain(word, at_word, form) AS (
    SELECT word, word, form FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.form)
SELECT f.word, n, n_near, f.form, form_n, c.at_word AS root FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
