"""Quotation linking: reply-ordered conversations without quotes.

A line behind ``>`` marks is quoted, as many levels deep as it has marks. Each quoted line is a passage; its normalised
text is hashed and looked for among the unquoted lines of earlier messages of its conversation, the latest one winning. A
message answers the one that most of its first-level passages come from (of equal ones the latest), and without any such
passage the message before it. Threads follow quotes only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import stored

_MARKS = r"^((?:\x20?>)+)"
#: "On Monday, somebody wrote:" in front of a quote belongs to the quote.
_ATTRIBUTION = r"(?i)^\s*on\x20.{1,200}\x20wrote:\s*$"
#: Turns of one conversation and passage that are put in order by one task.
CHUNK_TURNS = 256


def level(line: Column) -> Column:
    marks = F.regexp_extract(line, _MARKS, 1)
    return F.length(F.regexp_replace(marks, "[^>]", ""))


def normal(line: Column) -> Column:
    """The line without marks, lower-cased, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARKS, "")), r"\s+", " "))


def _latest(originals: DataFrame, quotes: DataFrame) -> DataFrame:
    """Each quote with ``source_turn``: the largest turn below its own that has its passage.

    Both sides are sorted together in chunks of turns, and the last turn of each chunk is carried to the chunks behind
    it, so a passage that everybody quotes is neither one task nor a set of pairs.
    """
    wanted = quotes.select("conv_id", "passage").distinct()
    have = originals.join(wanted, ["conv_id", "passage"], "left_semi").distinct()
    rows = have.select("conv_id", "passage", "turn", F.lit(None).cast("int").alias("level"), F.lit(True).alias("own")).unionByName(
        quotes.select("conv_id", "passage", "turn", "level", F.lit(False).alias("own")))
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / CHUNK_TURNS))
    inside = Window.partitionBy("conv_id", "passage", "chunk").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max(F.when(F.col("own"), F.col("turn"))).over(inside)).where(~F.col("own"))
    chunks = rows.groupBy("conv_id", "passage", "chunk").agg(F.max(F.when(F.col("own"), F.col("turn"))).alias("last"))
    before = Window.partitionBy("conv_id", "passage").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("far", F.max("last").over(before)).drop("last")
    return near.join(chunks, ["conv_id", "passage", "chunk"]).select("conv_id", "turn", "level", F.coalesce("near", "far").alias("source_turn"))


def _previous(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn`` (unique together) and ``_before``, the turn before it; a long conversation is many chunks."""
    rows = turns.withColumn("chunk", F.floor(F.col("turn") / CHUNK_TURNS))
    near = rows.withColumn("_near", F.lag("turn").over(Window.partitionBy("conv_id", "chunk").orderBy("turn")))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.max("turn").alias("last"))
    chunks = chunks.withColumn("_far", F.lag("last").over(Window.partitionBy("conv_id").orderBy("chunk"))).drop("last")
    return near.join(chunks, ["conv_id", "chunk"]).select("conv_id", "turn", F.coalesce("_near", "_far").alias("_before"))


def quoting_replies(messages: DataFrame) -> DataFrame:
    """Messages as they would come by mail: every reply quotes turns before it, by rule, in front of its own text.

    Turn t quotes ``1 + t % 3`` turns, the nearest at the first level, the one before it at the second and so on, deepest
    first; the nearest is turn t - 1, or t - 2 where ``t % 4 = 2``. Marks are ``>>`` at odd turns and ``> >`` at even ones.
    Of rows that share conversation and turn the smallest text is quoted. Turns that do not exist are not quoted.
    """
    placed = messages.where("conv_id is not null and turn is not null")
    said = placed.groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    source, level = F.col("turn"), F.col("level")
    # A turn may be quoted by the four behind it, at one level each.
    later = said.select("conv_id", "turn", "text", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("distance"))
    later = later.withColumn("reply", source + F.col("distance"))
    later = later.withColumn("level", F.col("distance") - (F.pmod("reply", F.lit(4)) == 2).cast("int"))
    later = later.where((level >= 1) & (level <= 1 + F.pmod("reply", F.lit(3))))
    marks = F.concat(F.repeat(F.when(F.pmod("reply", F.lit(2)) == 0, "> ").otherwise(">"), level), F.lit(" "))
    block = F.concat(F.lit("On turn "), source.cast("string"), F.lit(", A. wrote:\n"), marks, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), marks)))
    quoted = later.select("conv_id", F.col("reply").alias("turn"), F.struct((-level).alias("at"), block.alias("block")).alias("part"))
    # Three blocks of a reply at most.
    parts = quoted.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["block"]), "\n").alias("_quoted"))
    told = messages.join(parts, ["conv_id", "turn"], "left")
    whole = F.when(F.col("_quoted").isNull(), F.col("text")).otherwise(F.concat("_quoted", F.lit("\n"), F.coalesce("text", F.lit(""))))
    return told.select("conv_id", "turn", "role", whole.alias("text"))


def _threads(links: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``thread_turn`` and ``depth`` of every linked turn, by pointer doubling.

    A turn leaves the rounds when it points to a turn without link or to one that has left them, so each round works on the
    turns of threads longer than twice those of the round before.
    """
    names = ["conv_id", "turn", "thread_turn", "depth"]
    active = stored(links.select("conv_id", "turn", F.col("source_turn").alias("thread_turn"), F.lit(1).cast("long").alias("depth")))
    settled: list[DataFrame] = []
    while True:
        known = reduce(DataFrame.unionByName, [x.select(*names, F.lit(True).alias("done")) for x in settled], active.select(*names, F.lit(False).alias("done")))
        up = known.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("_up"), F.col("depth").alias("_more"), "done")
        moved = stored(
            active.join(up, ["conv_id", "thread_turn"], "left")
            .select("conv_id", "turn", F.coalesce("_up", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.coalesce("done", F.lit(True)).alias("done"))
        )
        settled.append(moved.where("done"))
        active = moved.where(~F.col("done")).select(*names)
        if not active.head(1):
            return reduce(DataFrame.unionByName, [x.select(*names) for x in settled])


def link_quotes(messages: DataFrame) -> DataFrame:
    """Messages (``conv_id``, ``turn``, ``role``, ``text``) in reply order, without their quotes.

    Returns ``conv_id``, ``thread_turn`` (the turn that began the thread), ``turn``, ``depth`` in it, ``role``,
    ``parent_turn`` (null for the first), ``n_levels``, ``n_quoted``, ``n_linked`` (passages whose origin was found) and
    ``text``, the unquoted lines. By ``conv_id, thread_turn, turn`` a message stands behind the one it answers. Blank
    passages are none. A null text is empty; messages without conversation or turn answer nothing; messages that share
    both are one message for linking and stay as many rows. An empty table gives an empty result. A long text is an array of
    lines in its row; other columns are not read.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\r?\n")
    rows = stored(messages.select("conv_id", "turn", "role", F.transform(lines, lambda x: F.struct(level(x).alias("level"), x.alias("line"))).alias("lines")))
    quoted = F.filter("lines", lambda x: (x["level"] > 0) & (normal(x["line"]) != ""))

    def owned(x: Column, i: Column) -> Column:
        ahead = F.get(F.col("lines"), i + 1)
        return (x["level"] == 0) & ~(x["line"].rlike(_ATTRIBUTION) & F.coalesce(ahead["level"] > 0, F.lit(False)))

    own = F.filter("lines", owned)
    placed = rows.where("conv_id is not null and turn is not null")
    passage = F.xxhash64(normal(F.col("x.line")), F.lit(1))
    quotes = stored(placed.select("conv_id", "turn", F.explode(quoted).alias("x")).select("conv_id", "turn", F.col("x.level").alias("level"), passage.alias("passage")))
    base = rows.select(
        "conv_id", "turn", "role", F.coalesce(F.array_max(F.transform(quoted, lambda x: x["level"])), F.lit(0)).alias("n_levels"),
        F.size(quoted).cast("long").alias("n_quoted"), F.array_join(F.transform(own, lambda x: x["line"]), "\n").alias("text"),
    )
    base = base.join(_previous(placed.select("conv_id", "turn").distinct()), ["conv_id", "turn"], "left")
    originals = placed.select("conv_id", "turn", F.explode(own).alias("x")).select("conv_id", "turn", passage.alias("passage"))
    found = stored(_latest(originals, quotes).where("source_turn is not null"))
    linked = found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"))
    votes = found.where("level = 1").groupBy("conv_id", "turn", "source_turn").agg(F.count("*").alias("n"))
    links = stored(votes.groupBy("conv_id", "turn").agg(F.max_by("source_turn", F.struct("n", "source_turn")).alias("source_turn")))
    out = base.join(linked, ["conv_id", "turn"], "left").join(links, ["conv_id", "turn"], "left").join(_threads(links), ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", F.coalesce("thread_turn", "turn").alias("thread_turn"), "turn", F.coalesce("depth", F.lit(0)).alias("depth"), "role",
        F.coalesce("source_turn", "_before").alias("parent_turn"), "n_levels", "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "text",
    )


# The same by joins of all lines of a conversation, over the replies of quoting_replies.
SQL = r"""
WITH RECURSIVE said AS (
    SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
blocks AS (
    SELECT r.conv_id, r.turn, string_agg(concat('On turn ', s.turn, ', A. wrote:', chr(10), marks, replace(s.text, chr(10), concat(chr(10), marks))), chr(10) ORDER BY level DESC) AS block
    FROM (SELECT conv_id, turn, level, turn - level - CASE WHEN turn % 4 = 2 THEN 1 ELSE 0 END AS source,
            concat(repeat(CASE WHEN turn % 2 = 0 THEN '> ' ELSE '>' END, level), ' ') AS marks
        FROM said, (VALUES (1), (2), (3)) v(level) WHERE level <= 1 + turn % 3) r
    JOIN said s ON s.conv_id = r.conv_id AND s.turn = r.source GROUP BY ALL),
messages AS (
    SELECT row_number() OVER () AS id, c.conv_id, c.turn, role, coalesce(CASE WHEN block IS NULL THEN text ELSE concat(block, chr(10), text) END, '') AS text
    FROM conversations c LEFT JOIN blocks b ON b.conv_id = c.conv_id AND b.turn = c.turn),
lines AS (
    SELECT id, conv_id, turn, i, line, length(regexp_replace(regexp_extract(line, '^((?: ?>)+)', 1), '[^>]', '', 'g')) AS level,
        trim(regexp_replace(lower(regexp_replace(line, '^((?: ?>)+)', '')), '\s+', ' ', 'g')) AS norm
    FROM (SELECT id, conv_id, turn, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS i FROM messages)),
marked AS (
    SELECT *, level = 0 AND NOT (regexp_matches(line, '(?i)^\s*on .{1,200} wrote:\s*$') AND coalesce(lead(level) OVER (PARTITION BY id ORDER BY i) > 0, false)) AS own,
        level > 0 AND norm <> '' AS quoted
    FROM lines),
found AS (
    SELECT q.id, q.i, q.conv_id, q.turn, q.level, max(o.turn) AS source_turn
    FROM (SELECT * FROM marked WHERE quoted) q JOIN (SELECT DISTINCT conv_id, turn, norm FROM marked WHERE own) o
        ON o.conv_id = q.conv_id AND o.norm = q.norm AND o.turn < q.turn GROUP BY ALL),
linked AS (SELECT conv_id, turn, count(*) AS n_linked FROM found GROUP BY ALL),
links AS (
    SELECT conv_id, turn, source_turn FROM (SELECT conv_id, turn, source_turn, count(*) AS n FROM found WHERE level = 1 GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, source_turn DESC) = 1),
walk AS (
    SELECT conv_id, turn, source_turn AS thread_turn, 1 AS depth FROM links
    UNION ALL SELECT w.conv_id, w.turn, l.source_turn, w.depth + 1 FROM walk w JOIN links l ON l.conv_id = w.conv_id AND l.turn = w.thread_turn),
threads AS (SELECT conv_id, turn, arg_max(thread_turn, depth) AS thread_turn, max(depth) AS depth FROM walk GROUP BY ALL),
previous AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM said)),
shown AS (
    SELECT id, CAST(coalesce(max(level) FILTER (quoted), 0) AS INTEGER) AS n_levels, count(*) FILTER (quoted) AS n_quoted,
        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (own), '') AS text
    FROM marked GROUP BY id)
SELECT m.conv_id, coalesce(t.thread_turn, m.turn) AS thread_turn, m.turn, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth, m.role,
    coalesce(l.source_turn, p.before) AS parent_turn, s.n_levels, s.n_quoted, coalesce(k.n_linked, 0) AS n_linked, s.text
FROM messages m JOIN shown s USING (id)
    LEFT JOIN previous p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN linked k ON k.conv_id = m.conv_id AND k.turn = m.turn
    LEFT JOIN links l ON l.conv_id = m.conv_id AND l.turn = m.turn LEFT JOIN threads t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""
