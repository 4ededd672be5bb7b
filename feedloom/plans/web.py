"""Queries on URLs, hosts, images and declared languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import language as L
from feedloom.functions import urls as U
from feedloom.operators.candidates import feed_context
from feedloom.operators.language import assign_language
from feedloom.operators.merge import url_owners
from feedloom.plans import mapping as M
from feedloom.plans.registry import query, table

# A page's URL without fragment and tracking parameter, and its language path segment.
_CORE = "regexp_replace(regexp_replace(url, '#.*$', ''), '[?]utm_source=feed$', '')"
_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"
_LANG = "regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


@query(
    "canonical_url",
    f"""SELECT page_id, CASE page_id % 5
            WHEN 0 THEN {_CORE}
            WHEN 1 THEN regexp_replace({_CORE}, '^(https?)://', '\\1://www.')
            WHEN 2 THEN CASE WHEN url LIKE 'https:%' THEN {_CORE} ELSE regexp_replace({_CORE}, '^(https?://[^/]+)', '\\1:443') END
            WHEN 3 THEN CASE WHEN url LIKE '%#%' THEN {_CORE} WHEN {_CORE} LIKE '%?%' THEN concat({_CORE}, '&id=', page_id)
                ELSE concat({_CORE}, '?id=', page_id) END
        END AS canonical_url FROM pages""",
)
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, n = F.col("url"), F.col("page_id") % 5
    joiner = F.when(url.contains("?"), "&").otherwise("?")
    shouted = F.replace(F.replace(url, F.lit("https://"), F.lit("HTTPS://Www.")), F.lit("http://"), F.lit("HTTP://Www."))
    raw = (
        F.when(n == 0, url)
        .when(n == 1, F.concat(F.lit("\u00a0 "), shouted, F.lit(" \t")))
        .when(n == 2, F.regexp_replace(url, "^(https?://[^/]+)", "$1:443"))
        .when(n == 3, F.concat(url, joiner, F.lit("utm_campaign=a&id="), F.col("page_id")))
        .otherwise(F.concat(F.lit("no url "), F.col("page_id")))
    )
    return _pages(spark, sf_dir).select("page_id", U.canonical_url(raw).alias("canonical_url"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = F.concat(F.lit("http://SHARED.example/"), F.col("page_id") % 50)
    long = F.concat(F.lit("https://long.example/"), F.repeat(F.lit("x"), 990))
    urls = F.array(F.lit("bad url"), F.lit(None), long, F.col("url"), shared, F.concat("url", F.lit("#again")))
    short = F.when(F.col("page_id") % 3 == 0, F.filter(urls, lambda u: ~u.contains("long"))).when(
        F.col("page_id") % 3 == 1, F.array(F.lit("bad url"))
    )
    return _pages(spark, sf_dir).withColumn("urls", F.coalesce(short, urls))


@query(
    "primary_url",
    f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN {_CORE} ELSE concat('https://long.example/', repeat('x', 990)) END
        AS primary_url FROM pages WHERE page_id % 3 <> 1""",
)
def primary_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listed(spark, sf_dir).select("page_id", U.primary_url(F.col("urls")).alias("primary_url"))
    return rows.where(F.col("primary_url").isNotNull())


_VARIANTS = f"""
    SELECT page_id, {_CORE} AS url FROM pages WHERE page_id % 3 <> 1
    UNION ALL SELECT page_id, concat('http://shared.example/', page_id % 50) FROM pages WHERE page_id % 3 <> 1
"""


@query("url_variants", _VARIANTS)
def url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir).select("page_id", F.explode(U.url_variants(F.col("urls"))).alias("url"))


@query("url_owner", f"SELECT url, concat('p', max(page_id)) AS article_key FROM ({_VARIANTS}) GROUP BY url")
def url_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listed(spark, sf_dir).select(
        F.col("page_id").alias("seq"), F.concat(F.lit("p"), F.col("page_id")).alias("resolved_key"),
        F.col("urls").alias("source_urls"),
    )
    return url_owners(rows)


@query(
    "image_url",
    """SELECT page_id, CASE WHEN page_id % 4 < 2 AND url LIKE 'https:%' THEN
            CASE page_id % 4 WHEN 0 THEN url ELSE concat('https://i.example/', repeat('a', 982)) END
        END AS image_url FROM pages""",
)
def image_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 4
    scheme = F.substring_index("url", ":", 1)
    fitting = F.concat(scheme, F.lit("://i.example/"), F.repeat(F.lit("a"), 982))
    raw = (
        F.when(n == 0, F.col("url"))
        .when(n == 1, fitting)
        .when(n == 2, F.concat(fitting, F.lit("aa")))
        .otherwise(F.concat(scheme, F.lit("://192.168.0.1/x.png")))
    )
    return _pages(spark, sf_dir).select("page_id", U.image_url(raw).alias("image_url"))


@query(
    "host_normalize",
    f"SELECT page_id, CASE WHEN page_id % 4 < 3 THEN lower({_HOST}) END AS host FROM pages",
)
def host_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, host = F.col("page_id") % 4, F.regexp_extract("url", "^https?://([^/]+)", 1)
    raw = (
        F.when(n == 0, F.concat(F.lit(" "), F.upper(host), F.lit(" ")))
        .when(n == 1, F.col("url"))
        .when(n == 2, F.concat(F.lit("me@"), host, F.lit(":8080/x")))
        .otherwise(F.lit("  "))
    )
    return _pages(spark, sf_dir).select("page_id", U.normalize_host(raw).alias("host"))


def _hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, lang = F.col("page_id") % 6, F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1)
    raw = (
        F.when(n == 1, F.replace(F.col("url"), F.lit(".example."), F.lit(".IT.")))
        .when(n == 2, F.concat(F.lit("https://a.example/x?lang="), F.upper(lang)))
        .when(n == 3, F.concat(F.lit("https://a.example/"), lang, F.lit("/x/nl.rss.xml?de=1")))
        .when(n == 4, F.concat(F.lit("https://a.example/x?a=1&fr="), lang))
        .when(n == 5, F.lit("https://a.example/english"))
        .otherwise(F.col("url"))
    )
    return _pages(spark, sf_dir).select("page_id", raw.alias("url"))


_HINT = f"""CASE page_id % 6 WHEN 0 THEN {_LANG} WHEN 1 THEN 'it' WHEN 2 THEN {_LANG} WHEN 3 THEN 'nl' WHEN 4 THEN 'fr' END"""


@query("url_language_hint", f"SELECT page_id, {_HINT} AS hint FROM pages")
def url_language_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hinted(spark, sf_dir).select("page_id", U.url_language_hint(F.col("url")).alias("hint"))


_COUNTRY = """CASE {0} WHEN 'fr' THEN 'fr' WHEN 'it' THEN 'it' WHEN 'de' THEN 'de' WHEN 'es' THEN 'es' WHEN 'pt' THEN 'pt'
    WHEN 'nl' THEN 'nl' WHEN 'se' THEN 'sv' WHEN 'no' THEN 'no' WHEN 'gr' THEN 'el' WHEN 'jp' THEN 'ja' WHEN 'kr' THEN 'ko'
    WHEN 'us' THEN 'en' WHEN 'gb' THEN 'en' END""".replace("{0}", f"substr(lower(trim({M.country_sql('{0}')})), 1, 2)")


@query(
    "country_language",
    f"SELECT c_custkey, {_COUNTRY.replace('{0}', 'c_nationkey')} AS language FROM customer",
)
def country_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    country = M.country_of(F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", L.country_language(country).alias("language"))


@query("feed_context", M.CONTEXT_SQL)
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_context(M.feeds(spark, sf_dir), M.companies(spark, sf_dir)).select(
        "feed_id", "feed_url", "company_id", "company_name", "country"
    )


@query(
    "language_cascade",
    f"""SELECT language, count(*) AS n FROM (
            SELECT coalesce({_COUNTRY.replace('{0}', 'page_id')}, {_HINT}, 'xx') AS language FROM pages) GROUP BY language""",
)
def language_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hinted(spark, sf_dir).select(
        L.declared_language(M.country_of(F.col("page_id")), F.array("url")).alias("declared"), F.lit("").alias("text")
    )
    return assign_language(rows).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_normalize",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN lang WHEN 2 THEN concat(lang, 'x') ELSE 'xx' END AS label
        FROM documents""",
)
def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, lang = F.col("doc_id") % 5, F.col("lang")
    raw = (
        F.when(n == 0, F.concat(F.lit("__label__"), F.upper(lang)))
        .when(n == 1, F.concat(F.lit(" "), lang, F.lit(" ")))
        .when(n == 2, F.concat(F.lit("__label__"), lang, F.lit("X")))
        .when(n == 3, F.concat(lang, lang))
        .otherwise(F.lit(" "))
    )
    return table(spark, sf_dir, "documents").select("doc_id", L.normalize_label(raw).alias("label"))
