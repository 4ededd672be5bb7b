"""Feed tables derived from the driver tables, for the registered queries.

Each view has the columns the operators expect. Conditions on remainders only vary the values of derived columns;
every view covers all rows of its source tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.plans.registry import table

COUNTRIES = [
    "fr", "it", "be", "eu", "US", " de ", "xx", "", "French Guiana", "ch", "jp", "se", "ca", "gb", "in",
    "es", "pt", "lu", "nl", "at", "gr", "no", "mx", "kr", "za",
]
COUNTRY_SQL = "[" + ", ".join(f"'{c}'" for c in COUNTRIES) + "]"


def country_of(col: Column) -> Column:
    """Country code of a nation key."""
    return F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), (F.pmod(col, F.lit(25)) + 1).cast("int"))


def country_sql(col: str) -> str:
    return f"list_extract({COUNTRY_SQL}, CAST({col} % 25 AS INTEGER) + 1)"


def every(col: str, n: int, hit: int = 0) -> Column:
    return F.col(col) % n == hit


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as companies."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_name").alias("name"),
        country_of(F.col("n_nationkey")).alias("country"),
        F.concat(F.lit(" https://WWW."), F.col("n_name"), F.lit(".Example:8080/feeds ")).alias("host"),
        F.when(F.col("n_nationkey") % 4 == 0, F.lit(None)).otherwise(F.col("n_nationkey") % 4 - 1).cast("int").alias("fetchprotection"),
    )


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as feeds; some belong to a company that does not exist."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("https://feeds.example/"), F.col("s_suppkey"), F.when(every("s_suppkey", 5), "/it.rss").otherwise("/x.xml")).alias("url"),
        F.when(every("s_suppkey", 7), F.lit(99)).otherwise(F.col("s_nationkey")).cast("bigint").alias("company_id"),
    )


# The same feeds and companies for the checking SQL.
CONTEXT_SQL = f"""
    SELECT s_suppkey AS feed_id,
        concat('https://feeds.example/', s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '/it.rss' ELSE '/x.xml' END) AS feed_url,
        CAST(CASE WHEN s_suppkey % 7 = 0 THEN 99 ELSE s_nationkey END AS BIGINT) AS company_id,
        n_name AS company_name,
        coalesce(nullif({country_sql('n_nationkey')}, ''), 'xx') AS country
    FROM supplier
    LEFT JOIN nation ON n_nationkey = CASE WHEN s_suppkey % 7 = 0 THEN 99 ELSE s_nationkey END
"""


def result_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as result events with one to three sources; the last one has no usable URL."""
    docs = table(spark, sf_dir, "documents", spread=True)
    published = F.when(~every("doc_id", 7), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60))
    byline = F.concat(F.lit("By Ada "), F.initcap("source"), F.lit(" and Alan Turing"))
    title = F.substring_index("text", "\n", 1)

    def source(urls: list[Column], authors: Column, author: Column) -> Column:
        return F.struct(
            title.alias("title"),
            F.when(~every("doc_id", 13), F.col("text")).alias("summary"),
            F.array(*urls).alias("urls"),
            published.alias("published_at"),
            author.cast("string").alias("author"),
            authors.cast("array<string>").alias("authors"),
            F.concat(F.lit("https://img.example/"), "doc_id", F.lit(".png")).alias("image_url"),
        )

    page = F.concat(F.lit("https://News.Example/"), F.col("lang"), F.lit("/"), F.col("doc_id"))
    copy = F.concat(F.lit("https://mirror.example/"), F.col("doc_id") % 50)
    sources = F.array(
        source([F.lit("bad url"), F.concat(page, F.lit("?utm_source=x#top")), F.concat(page, F.lit("?id=1"))], F.lit(None), byline),
        F.when(every("doc_id", 4), source([copy], F.array(byline, F.lit("Alan Turing")), F.lit("AFP"))),
        F.when(every("doc_id", 6), source([F.lit("ftp://x.example/a")], F.lit(None), byline)),
    )
    return docs.select(
        F.col("doc_id").alias("event_seq"),
        (F.col("doc_id") * 7 % 120).alias("feed_id"),
        F.concat(F.lit("job"), F.col("doc_id") % 10).alias("job_id"),
        F.when(every("doc_id", 9), "error").otherwise("success").alias("status"),
        F.when(every("doc_id", 9), 503).cast("int").alias("status_code"),
        F.lit(None).cast("string").alias("new_etag"),
        F.lit(None).cast("timestamp").alias("new_last_update"),
        F.filter(sources, lambda s: s.isNotNull()).alias("sources"),
    )


def _ident(col: str) -> str:
    plain = f"regexp_replace(strip_accents(replace(lower({col}), 'ß', 'ss')), '\\p{{M}}+', '', 'g')"
    return f"nullif(trim(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '')"


def ident_sql(col: str) -> str:
    """Identity text of an SQL expression."""
    return _ident(col)


# The candidates of the result events above, with the known answer for the cleaned authors.
CANDIDATES_SQL = f"""
    WITH context AS ({CONTEXT_SQL}),
    src AS (
        SELECT doc_id, 0 AS source_pos, concat('https://news.example/', lang, '/', doc_id) AS canonical_url,
            concat('Ada ', upper(source[1]), source[2:], '|Alan Turing') AS authors, lang AS path_lang FROM documents
        UNION ALL
        SELECT doc_id, 1, concat('https://mirror.example/', doc_id % 50),
            concat('Ada ', upper(source[1]), source[2:], '|Alan Turing|AFP'), NULL FROM documents WHERE doc_id % 4 = 0
    ),
    full_src AS (
        SELECT src.*, (doc_id * 7 % 120) AS feed_id, string_split(text, chr(10))[1] AS title,
            CASE WHEN doc_id % 13 <> 0 THEN text END AS summary,
            CASE WHEN doc_id % 7 <> 0 THEN strftime(TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS published
        FROM src JOIN documents USING (doc_id)
    ),
    cand AS (
        SELECT doc_id AS event_seq, source_pos, f.feed_id, canonical_url, authors, company_id,
            concat('https://img.example/', doc_id, '.png') AS image_url, coalesce(country, 'xx') AS country,
            sha256(concat_ws(chr(31), canonical_url, coalesce({_ident('title')}, ''), replace(lower(authors), '|', ','),
                coalesce({_ident('company_name')}, ''), coalesce(published, ''))) AS article_key,
            CASE WHEN {_ident('title')} IS NOT NULL AND {_ident('summary')} IS NOT NULL THEN
                sha256(concat_ws(chr(31), {_ident('title')}, {_ident('summary')}, coalesce({_ident('company_name')}, ''), coalesce(published, '')))
            END AS content_key,
            coalesce(
                CASE substr(lower(trim(coalesce(country, 'xx'))), 1, 2)
                    WHEN 'fr' THEN 'fr' WHEN 'it' THEN 'it' WHEN 'us' THEN 'en' WHEN 'de' THEN 'de' WHEN 'jp' THEN 'ja'
                    WHEN 'se' THEN 'sv' WHEN 'gb' THEN 'en' WHEN 'es' THEN 'es' WHEN 'pt' THEN 'pt' WHEN 'nl' THEN 'nl'
                    WHEN 'gr' THEN 'el' WHEN 'no' THEN 'no' WHEN 'kr' THEN 'ko' END,
                path_lang,
                CASE WHEN feed_url LIKE '%it.rss' THEN 'it' END,
                'xx') AS language
        FROM full_src f LEFT JOIN context USING (feed_id)
    )
"""
