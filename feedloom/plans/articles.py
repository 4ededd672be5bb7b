"""Queries on keys, candidates, entity resolution, the article store and authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.authors import clean_authors
from feedloom.functions.keys import article_key, content_key
from feedloom.functions.text import identity_text
from feedloom.operators import merge
from feedloom.operators.candidates import build_candidates, feed_context, flag_duplicates
from feedloom.operators.resolve import best_by_content, resolve
from feedloom.operators.resultsets import resolve_sets
from feedloom.plans import mapping as M
from feedloom.plans.registry import query, sql_stamp, stamp, table
from feedloom.session import cut_lineage

AS_OF = "2025-01-01 00:00:00"


@query("identity_text", f"SELECT doc_id, md5({M.ident_sql('text')}) AS digest FROM documents")
def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", spread=True).select("doc_id", F.md5(identity_text(F.col("text"))).alias("digest"))


_TITLE = "string_split(text, chr(10))[1]"
_TIME = "strftime(TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S.%f+00:00')"


@query(
    "article_keys",
    f"""SELECT doc_id,
            sha256(concat_ws(chr(31), concat('u', doc_id), coalesce({M.ident_sql(_TITLE)}, ''), concat('ada ', source), source, {_TIME})) AS article_key,
            CASE WHEN {M.ident_sql(_TITLE)} IS NOT NULL AND {M.ident_sql('text')} IS NOT NULL AND doc_id % 5 <> 0 THEN
                sha256(concat_ws(chr(31), {M.ident_sql(_TITLE)}, {M.ident_sql('text')}, source, '')) END AS content_key
        FROM documents""",
)
def article_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.substring_index("text", "\n", 1)
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    summary = F.when(F.col("doc_id") % 5 != 0, F.col("text"))
    authors = F.array(F.concat(F.lit("Ada-"), "source"))
    return table(spark, sf_dir, "documents", spread=True).select(
        "doc_id",
        article_key(F.concat(F.lit("u"), "doc_id"), title, authors, F.upper("source"), at).alias("article_key"),
        content_key(title, summary, F.col("source"), F.lit(None).cast("timestamp")).alias("content_key"),
    )


# Byline templates with their names; {a} and {b} are two-word names taken from the part table.
BYLINES = [
    ("By {a} and {b}", "{a}|{b}"),
    ("{a} et AFP", "{a}|AFP"),
    ("{w} and Development", "{w} and Development"),
    ("{a} (AFP (Paris))", "{a}"),
    ("Propos recueillis par {a}", "{a}"),
    ("Texte de notre correspondant {a}", ""),
    ("{a}, correspondant à Rome", "{a}"),
    ("correspondante en Asie", "correspondante en Asie"),
    ("special correspondent", ""),
    ("{a} in Paris", "{a}"),
    ("avec {a}", "{a}"),
    ("{a} avec AFP", "{a}"),
    ("www.example.com", ""),
    ("The {w} newsroom team", ""),
    ('"{a}"; {a} ,  {b}', "{a}|{b}"),
    ("{a} Regional Editor", "{a}"),
    ("{a}, Regional Editor", "{a}|Regional Editor"),
    ("{w} A Lopez", "{w}"),
    ("{a} edited by {b} &  REUTERS", "{a}|{b}|REUTERS"),
    ("{w} van der {w}  de", "{w} van der {w} de"),
    ("  ", ""),
]
_A, _B, _W = "concat(upper(p_name[1]), p_name[2:])", "concat('Éva ', upper(p_type[1]), lower(p_type[2:]))", "concat(upper(p_name[1]), string_split(p_name, ' ')[1][2:])"


def _template_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN '{want}'" for i, (_, want) in enumerate(BYLINES))
    named = f"replace(replace(replace(CASE p_partkey % {len(BYLINES)} {cases} END, '{{a}}', {_A}), '{{b}}', {_B}), '{{w}}', {_W})"
    return f"SELECT p_partkey, {named} AS authors FROM part"


@query("authors_clean", _template_sql())
def authors_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part", spread=True).select("p_partkey", "p_name", "p_type")
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    fill = {"{a}": name, "{b}": F.concat(F.lit("Éva "), F.initcap("p_type")), "{w}": F.substring_index(name, " ", 1)}
    byline = F.element_at(F.array(*[F.lit(t) for t, _ in BYLINES]), (F.col("p_partkey") % len(BYLINES) + 1).cast("int"))
    for mark, value in fill.items():
        byline = F.replace(byline, F.lit(mark), value)
    as_list = F.when(F.col("p_partkey") % 2 == 0, F.array(byline))
    author = F.when((F.col("p_partkey") % 2 != 0) | (F.col("p_partkey") % 3 != 1), byline)
    rows = parts.select("p_partkey", as_list.alias("authors"), author.alias("author"))
    return rows.select("p_partkey", F.array_join(clean_authors("authors", "author"), "|").alias("authors"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = feed_context(M.feeds(spark, sf_dir), M.companies(spark, sf_dir))
    return build_candidates(M.result_events(spark, sf_dir), contexts)


@query(
    "candidates",
    f"""{M.CANDIDATES_SQL} SELECT event_seq, CAST(source_pos AS INTEGER) AS source_pos, feed_id, article_key, content_key,
        canonical_url, authors, image_url, company_id, country, language FROM cand""",
)
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select(
        "event_seq", "seq.source_pos", "feed_id", "article_key", "content_key", "canonical_url",
        F.array_join("authors", "|").alias("authors"), "image_url", "company_id", "country", "language",
    )


@query(
    "duplicate_hint",
    f"""{M.CANDIDATES_SQL}, stored AS (SELECT * FROM cand WHERE event_seq IN (SELECT doc_id FROM labels WHERE quality = 1))
        SELECT event_seq, CAST(source_pos AS INTEGER) AS source_pos,
            row_number() OVER (PARTITION BY article_key ORDER BY event_seq, source_pos) > 1
            OR (content_key IS NOT NULL AND row_number() OVER (PARTITION BY content_key ORDER BY event_seq, source_pos) > 1)
            OR article_key IN (SELECT article_key FROM stored)
            OR coalesce(content_key IN (SELECT content_key FROM stored WHERE content_key IS NOT NULL), false) AS duplicate_hint
        FROM cand""",
)
def duplicate_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, stored = hinted_batch(spark, sf_dir)
    stored = stored.groupBy("article_key").agg(F.min_by("content_key", "seq").alias("content_key"))
    return flag_duplicates(batch, stored).select("event_seq", "seq.source_pos", "duplicate_hint")


def hinted_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keys of all candidates, and those of them that are stored already."""
    batch = cut_lineage(_candidates(spark, sf_dir).select("seq", "event_seq", "article_key", "content_key"))
    return batch, batch.join(_good(spark, sf_dir, "event_seq"), "event_seq", "left_semi")


def _good(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Ids of the documents labelled as good; they play the part of what is stored already."""
    return table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias(name))


def _key() -> Column:
    return F.concat_ws("-", F.lit("k"), "lang", "n_chars")


def _content(n: Column) -> Column:
    coarse = F.concat_ws("-", F.lit("c"), "source", F.expr("n_chars div 100"))
    return F.when(n % 11 == 0, F.lit(None)).when(n % 3 == 0, F.md5("text")).otherwise(coarse)


def stored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents as stored articles, the first of each key; their content is that of a later document."""
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    other = docs.select((n - 5).alias("doc_id"), _content(n).alias("content_key"))
    first = docs.join(_good(spark, sf_dir, "doc_id"), "doc_id", "left_semi").groupBy(_key().alias("article_key"))
    stored = first.agg(F.min("doc_id").alias("doc_id"), F.min("lang").alias("lang"))
    return stored.join(other, "doc_id", "left").select(
        "article_key",
        "content_key",
        F.timestamp_seconds(F.lit(1600000000) + n * 60).alias("published_at"),
        F.timestamp_seconds(F.lit(1700000000) + n % 40).alias("ingested_at"),
        F.concat(F.lit("https://old.example/"), n).alias("canonical_url"),
        F.concat(F.lit("old "), n).alias("title"),
        F.when(n % 2 == 0, "old summary").alias("summary"),
        F.lit(None).cast("string").alias("image_url"),
        F.lit("be").alias("country"),
        F.when(n % 3 == 0, "xx").when(n % 3 == 1, "").otherwise(F.col("lang")).alias("language"),
        F.when(n % 4 == 0, n).alias("company_id"),
    )


def batch_candidates(docs: DataFrame) -> DataFrame:
    """Documents in order as candidates that share article keys and content keys."""
    n = F.col("doc_id")
    return docs.select(
        n.alias("seq"),
        (n % 9).alias("feed_id"),
        _key().alias("article_key"),
        _content(n).alias("content_key"),
        F.when(n % 4 != 0, F.timestamp_seconds(F.lit(1704067200) + n * 60)).alias("published_at"),
        F.concat(F.lit("https://new.example/"), n).alias("canonical_url"),
        F.array(
            F.concat(F.lit("https://new.example/"), n, F.lit("?utm_medium=m")), F.concat(F.lit("https://new.example/t"), n % 70)
        ).alias("source_urls"),
        F.when(n % 6 == 0, "").otherwise(F.concat(F.lit("new "), n)).alias("title"),
        F.when(n % 5 != 0, F.md5("text")).alias("summary"),
        F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.initcap("source"), F.concat(F.lit("Zoé "), "lang"))).alias("authors"),
        F.when(n % 7 == 0, F.concat(F.lit("https://i.example/"), n)).alias("image_url"),
        F.when(n % 8 == 0, n).alias("company_id"),
        F.when(n % 9 == 0, "").when(n % 9 == 1, "xx").otherwise("fr").alias("country"),
        F.when(n % 2 == 0, "xx").otherwise(F.col("lang")).alias("language"),
    )


# A row-at-a-time walk over the batch: maps from keys to articles are carried from row to row.
_WALK = """
    WITH RECURSIVE content AS (
        SELECT doc_id, lang, concat_ws('-', 'k', lang, n_chars) AS k,
            CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN md5(text) ELSE concat_ws('-', 'c', source, n_chars // 100) END AS ck
        FROM documents),
    stored AS (
        SELECT d.doc_id, d.k, c.ck, TIMESTAMP '1970-01-01' + (1600000000 + d.doc_id * 60) * INTERVAL 1 SECOND AS published_at,
            TIMESTAMP '1970-01-01' + (1700000000 + d.doc_id % 40) * INTERVAL 1 SECOND AS ingested_at, lang
        FROM (SELECT k, min(doc_id) AS doc_id, min(lang) AS lang FROM content WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY k) d
        LEFT JOIN (SELECT doc_id, ck FROM content) c ON c.doc_id = d.doc_id + 5),
    best AS (SELECT ck, arg_max(k, doc_id) AS k FROM stored WHERE ck IS NOT NULL GROUP BY ck),
    batch AS (
        SELECT b.doc_id, b.k, b.ck, s.k AS by_key, t.k AS by_content
        FROM content b LEFT JOIN stored s ON s.k = b.k LEFT JOIN best t ON t.ck = b.ck),
    walk AS (
        SELECT -1::BIGINT AS doc_id, NULL::VARCHAR AS art, false AS root, MAP {'': ''} AS keys, MAP {'': ''} AS contents
        UNION ALL
        SELECT b.doc_id, s.art, s.known IS NULL,
            map_concat(w.keys, CASE WHEN s.known IS NULL THEN MAP {s.art: s.art} ELSE MAP {'': ''} END, MAP {b.k: s.art}),
            CASE WHEN b.ck IS NULL THEN w.contents ELSE map_concat(w.contents, MAP {b.ck: s.art}) END
        FROM walk w JOIN batch b ON b.doc_id = w.doc_id + 1,
            LATERAL (SELECT coalesce(w.keys[b.k], w.contents[coalesce(b.ck, '-')]) AS known,
                coalesce(w.keys[b.k], w.contents[coalesce(b.ck, '-')], b.by_key, b.by_content, b.k) AS art) s),
    resolved AS (SELECT doc_id, art, root FROM walk WHERE doc_id >= 0)
"""


@query("article_resolution", f"{_WALK} SELECT doc_id AS seq, art AS resolved_key, root AS is_root FROM resolved")
def article_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("seq", "resolved_key", "is_root")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = batch_candidates(table(spark, sf_dir, "documents"))
    return resolve(batch, stored_articles(spark, sf_dir))


@query(
    "content_match",
    """WITH stored AS (SELECT md5(text) AS content_key, concat('s', doc_id) AS article_key, doc_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 50 END AS p FROM documents)
        SELECT content_key, article_key AS stored_key FROM stored
        QUALIFY row_number() OVER (PARTITION BY content_key ORDER BY p DESC NULLS LAST, doc_id % 7 DESC, article_key DESC) = 1""",
)
def content_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    stored = table(spark, sf_dir, "documents").select(
        F.md5("text").alias("content_key"),
        F.concat(F.lit("s"), n).alias("article_key"),
        F.when(n % 4 != 0, F.timestamp_seconds(n % 50)).alias("published_at"),
        F.timestamp_seconds(n % 7).alias("ingested_at"),
    )
    return best_by_content(stored)


UPSERT_SQL = f"""{_WALK},
    fold AS (
        SELECT art, arg_min(published, doc_id) FILTER (published IS NOT NULL) AS published_at, arg_min(ck, doc_id) FILTER (ck IS NOT NULL) AS ck,
            arg_max(url, doc_id) AS url, arg_max(title, doc_id) FILTER (title <> '') AS title, arg_max(summary, doc_id) FILTER (summary IS NOT NULL) AS summary,
            arg_max(image, doc_id) FILTER (image IS NOT NULL) AS image, arg_max(company, doc_id) FILTER (company IS NOT NULL) AS company,
            arg_max(country, doc_id) FILTER (country <> '') AS country, arg_min(language, doc_id) FILTER (language <> 'xx') AS language
        FROM (
            SELECT r.art, r.doc_id, c.ck, CASE WHEN r.doc_id % 4 <> 0 THEN TIMESTAMP '2024-01-01' + r.doc_id * INTERVAL 1 MINUTE END AS published,
                concat('https://new.example/', r.doc_id) AS url, CASE WHEN r.doc_id % 6 = 0 THEN '' ELSE concat('new ', r.doc_id) END AS title,
                CASE WHEN r.doc_id % 5 <> 0 THEN md5(text) END AS summary, CASE WHEN r.doc_id % 7 = 0 THEN concat('https://i.example/', r.doc_id) END AS image,
                CASE WHEN r.doc_id % 8 = 0 THEN r.doc_id END AS company,
                CASE r.doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'xx' ELSE 'fr' END AS country, CASE WHEN r.doc_id % 2 = 0 THEN 'xx' ELSE lang END AS language
            FROM resolved r JOIN documents USING (doc_id) JOIN (SELECT doc_id, ck FROM content) c USING (doc_id) WHERE root)
        GROUP BY art)
    SELECT coalesce(art, k) AS article_key, coalesce(s.ck, f.ck) AS content_key, {sql_stamp('coalesce(s.published_at, f.published_at)')} AS published_at,
        {sql_stamp(f"coalesce(s.ingested_at, TIMESTAMP '{AS_OF}')")} AS ingested_at,
        coalesce(f.url, concat('https://old.example/', s.doc_id)) AS canonical_url, coalesce(f.title, 'old ' || s.doc_id, '') AS title,
        coalesce(f.summary, CASE WHEN s.doc_id % 2 = 0 THEN 'old summary' END) AS summary, f.image AS image_url,
        coalesce(f.company, CASE WHEN s.doc_id % 4 = 0 THEN s.doc_id END) AS company_id,
        coalesce(f.country, CASE WHEN s.doc_id IS NOT NULL THEN 'be' END, 'xx') AS country,
        CASE WHEN s.doc_id IS NOT NULL AND s.doc_id % 3 = 2 THEN s.lang WHEN art IS NULL THEN CASE s.doc_id % 3 WHEN 0 THEN 'xx' ELSE '' END
            ELSE coalesce(f.language, 'xx') END AS language
    FROM fold f FULL JOIN stored s ON s.k = f.art
"""


def show_articles(articles: DataFrame) -> DataFrame:
    shown = articles.withColumns({"published_at": stamp("published_at"), "ingested_at": stamp("ingested_at")})
    return shown.withColumn("title", F.coalesce("title", F.lit("")))


@query("article_upsert", UPSERT_SQL)
def article_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = cut_lineage(_resolved(spark, sf_dir))
    as_of = F.lit(AS_OF).cast("timestamp")
    return show_articles(merge.merge_articles(stored_articles(spark, sf_dir), resolved, as_of))


#: Documents in one result set.
SET_ROWS = 40

# The same walk over result sets: the maps of a set start empty, and a set looks up the articles that the sets before it left.
_SET_WALK = f"""{_WALK.split("walk AS (")[0]}
    walk AS (
        SELECT -1::BIGINT AS doc_id, -1::BIGINT AS set_id, NULL::VARCHAR AS art, false AS root, MAP {{'': ''}} AS keys, MAP {{'': ''}} AS contents,
            start.articles AS before, start.articles AS articles
        FROM (SELECT map(list(k ORDER BY k), list({{'ck': ck, 'p': published_at, 'i': ingested_at}} ORDER BY k)) AS articles FROM stored) start
        UNION ALL
        SELECT b.doc_id, b.set_id, s.art, s.known IS NULL,
            map_concat(m.keys, CASE WHEN s.known IS NULL THEN MAP {{s.art: s.art}} ELSE MAP {{'': ''}} END, MAP {{b.k: s.art}}),
            CASE WHEN b.ck IS NULL THEN m.contents ELSE map_concat(m.contents, MAP {{b.ck: s.art}}) END,
            m.before,
            CASE WHEN s.known IS NOT NULL THEN w.articles ELSE map_concat(w.articles, MAP {{s.art: {{
                'ck': coalesce(w.articles[s.art].ck, b.ck), 'p': coalesce(w.articles[s.art].p, b.published),
                'i': coalesce(w.articles[s.art].i, TIMESTAMP '{AS_OF}')}}}}) END
        FROM walk w JOIN (
                SELECT doc_id, doc_id // {SET_ROWS} AS set_id, k, ck, CASE WHEN doc_id % 4 <> 0 THEN TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE END AS published
                FROM content) b ON b.doc_id = w.doc_id + 1,
            LATERAL (SELECT CASE WHEN b.set_id = w.set_id THEN w.keys ELSE MAP {{'': ''}} END AS keys,
                CASE WHEN b.set_id = w.set_id THEN w.contents ELSE MAP {{'': ''}} END AS contents,
                CASE WHEN b.set_id = w.set_id THEN w.before ELSE w.articles END AS before) m,
            LATERAL (SELECT coalesce(m.keys[b.k], m.contents[coalesce(b.ck, '-')]) AS known,
                coalesce(m.keys[b.k], m.contents[coalesce(b.ck, '-')], CASE WHEN m.before[b.k] IS NOT NULL THEN b.k END,
                    list_sort(list_transform(list_filter(map_entries(m.before), lambda e: e.value.ck = b.ck),
                        lambda e: {{'p': coalesce(e.value.p, TIMESTAMP '1900-01-01'), 'i': e.value.i, 'k': e.key}}), 'DESC')[1].k,
                    b.k) AS art) s),
    resolved AS (SELECT doc_id, art, root FROM walk WHERE doc_id >= 0)
"""


@query("article_resolution_sets", f"{_SET_WALK} SELECT doc_id AS seq, art AS resolved_key, root AS is_root FROM resolved")
def article_resolution_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved_sets(spark, sf_dir).select("seq", "resolved_key", "is_root")


def in_sets(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("set_id", F.floor(F.col("seq") / SET_ROWS).cast("long"))


def _resolved_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = cut_lineage(in_sets(batch_candidates(table(spark, sf_dir, "documents"))))
    return resolve_sets(batch, cut_lineage(stored_articles(spark, sf_dir)), F.lit(AS_OF).cast("timestamp"))


SETS_UPSERT_SQL = UPSERT_SQL.replace(_WALK, _SET_WALK)


@query("article_upsert_sets", SETS_UPSERT_SQL)
def article_upsert_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = cut_lineage(_resolved_sets(spark, sf_dir))
    return show_articles(merge.merge_articles(stored_articles(spark, sf_dir), resolved, F.lit(AS_OF).cast("timestamp")))


_NAMED = """(SELECT doc_id, p AS position, CASE p WHEN 1 THEN concat(upper(source[1]), source[2:]) ELSE concat('Zoé ', lang) END AS name,
    CASE p WHEN 1 THEN source ELSE concat('zoe ', lang) END AS normalized_name FROM documents, (VALUES (1), (2)) v(p) WHERE doc_id % 3 <> 0)"""


@query("author_dim", f"SELECT normalized_name, arg_min(name, doc_id * 10 + position) AS display_name FROM {_NAMED} GROUP BY 1")
def author_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.author_dim(batch_candidates(table(spark, sf_dir, "documents")))


def _by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates taken as resolved to their own key."""
    return batch_candidates(table(spark, sf_dir, "documents")).withColumn("resolved_key", F.col("article_key"))


@query(
    "author_bridge",
    f"""WITH last AS (
            SELECT concat_ws('-', 'k', lang, n_chars) AS k, max(doc_id) AS doc_id FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1)
        SELECT k AS article_key, position, normalized_name, name AS display_name FROM last JOIN {_NAMED} USING (doc_id)""",
)
def author_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_key(spark, sf_dir)
    bridge = merge.author_bridge(merge.last_author_lists(rows))
    lists = merge.author_lists(bridge, merge.author_dim(rows))
    shown = lists.select("article_key", F.posexplode("authors").alias("pos", "display_name"))
    named = shown.select("article_key", (F.col("pos") + 1).alias("position"), "display_name")
    return bridge.join(named, ["article_key", "position"])


@query(
    "feed_links",
    f"""SELECT event_type AS article_key, user_id AS feed_id, {sql_stamp('min(ts)')} AS first_seen_at FROM events GROUP BY ALL""",
)
def feed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("resolved_key"), F.col("user_id").alias("feed_id"), "ts"
    )
    return merge.feed_links(rows, F.col("ts")).withColumn("first_seen_at", stamp("first_seen_at"))
