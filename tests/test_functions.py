"""Golden rows of the column functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feedloom.functions import language as L
from feedloom.functions import urls as U
from feedloom.functions.authors import clean_authors
from feedloom.functions.keys import article_key, clean_ref_ids, content_key, parse_payload_ref
from feedloom.functions.text import identity_text

AUTHORS = {
    "By Ada Lovelace and Alan Turing": ["Ada Lovelace", "Alan Turing"],
    "Marie Curie et AFP": ["Marie Curie", "AFP"],
    "Research and Development": ["Research and Development"],
    "Jean Dupont (AFP)": ["Jean Dupont"],
    "Jean Dupont ((((((AFP)a)b)c)d)e)": ["Jean Dupont"],
    "Jean Dupont (AFP": ["Jean Dupont (AFP"],
    "Propos recueillis par Léa Martin": ["Léa Martin"],
    "Text by Sam Lee": ["Sam Lee"],
    "de notre correspondant Jean Petit": [],
    "Jean Dupont, correspondant à Rome": ["Jean Dupont"],
    "correspondant à Rome": ["correspondant à Rome"],
    "correspondant à Rome, Jean Dupont": ["correspondant à Rome", "Jean Dupont"],
    "correspondent": [],
    "Alice Smith in Paris": ["Alice Smith"],
    "Alice Smith - special correspondent": ["Alice Smith"],
    "avec Paul Durand": ["Paul Durand"],
    "Paul Durand avec AFP": ["Paul Durand"],
    "example.com avec Paul Durand": ["Paul Durand"],
    "example.com": [],
    "The newsroom team": [],
    "in Paris": [],
    "In Paris": ["In Paris"],
    "Ada Lovelace; ada lovelace": ["Ada Lovelace"],
    "Ludwig van Beethoven": ["Ludwig van Beethoven"],
    "Jane Roe Regional Editor": ["Jane Roe"],
    "Jane Roe, Regional Editor": ["Jane Roe", "Regional Editor"],
    "J.-P. Roe Regional Editor": ["J.-P. Roe"],
    "Jean de la Editor": ["Jean"],
    "Maria A Lopez": ["Maria"],
    "Tom Fox edited by Ann Ray": ["Tom Fox", "Ann Ray"],
    " 'Zoé' Klein ": ["Zoé' Klein"],
    "!!!": [],
    "": [],
    "  ": [],
}


def test_authors_of_one_byline(spark):
    rows = spark.createDataFrame([(b,) for b in AUTHORS], "b string")
    rows = rows.withColumn("list", F.lit(None).cast("array<string>"))
    got = {r.b: r.a for r in rows.select("b", clean_authors("list", "b").alias("a")).collect()}
    assert got == AUTHORS


def test_authors_of_a_list_and_a_byline(spark):
    rows = spark.createDataFrame(
        [(1, ["Ada Lovelace", None, "by ADA LOVELACE; Ann Ray"], "Ann  Ray"), (2, None, None), (3, [], "Bo Li")],
        "id int, authors array<string>, author string",
    )
    got = {r.id: r.a for r in rows.select("id", clean_authors("authors", "author").alias("a")).collect()}
    assert got == {1: ["Ada Lovelace", "Ann Ray"], 2: [], 3: ["Bo Li"]}


CANONICAL = {
    "https://tide.example/n?utm_campaign=x&no=7": "https://tide.example/n?no=7",
    "https://tide.example/n?no=7": "https://tide.example/n?no=7",
    "HTTP://Ex.COM:80/A?x=1#f": "http://ex.com/A?x=1",
    "https://a_b.com:8443?q": "https://a_b.com:8443?q",
    "https://ex.com/?utm_medium=a&UTM_term=b": "https://ex.com/",
    "ftp://ex.com/a": None,
    "https:///a": None,
    "https://a b.com/": None,
    "": None,
    None: None,
}
HINTS = {
    "https://press.harbour.eu/en/feed/notes.aspx": "en",
    "https://lemonde.fr/en/x": "fr",
    "https://a.example/de/x/nl.rss": "nl",
    "https://a.example/nl.rss.xml": "nl",
    "https://a.example/nl.xml.rss": None,
    "https://a.example/x?lang=IT": "it",
    "https://a.example/x?fr=en": "fr",
    "https://a.example/x?l=%65n&m": "en",
    "https://a.example/x?l=%zz&en": "en",
    "https://me:de@a.example:80/x": None,
    "a.example/fr/x": "fr",
    None: None,
}


def test_urls(spark):
    rows = spark.createDataFrame([(u,) for u in CANONICAL], "u string")
    assert {r.u: r.c for r in rows.select("u", U.canonical_url(F.col("u")).alias("c")).collect()} == CANONICAL
    rows = spark.createDataFrame([(u,) for u in HINTS], "u string")
    assert {r.u: r.h for r in rows.select("u", U.url_language_hint(F.col("u")).alias("h")).collect()} == HINTS
    urls = F.array(*[F.lit(u) for u in list(CANONICAL)[:3]])
    got = spark.range(1).select(U.url_variants(urls).alias("v"), U.primary_url(urls).alias("p")).first()
    assert got.v == ["https://tide.example/n?no=7", "http://ex.com/A?x=1"]
    assert got.p == "https://tide.example/n?no=7"


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://tide.example/p/9.webp", "https://tide.example/p/9.webp"),
        ("https://example.com/" + "a" * 980, "https://example.com/" + "a" * 980),
        ("https://example.com/" + "a" * 981, None),
        ("http://tide.example/p/9.webp", None),
        ("https://localhost/image.png", None),
        ("https://10.0.0.1/image.png", None),
    ],
)
def test_image(spark, url, want):
    assert spark.range(1).select(U.image_url(F.lit(url)).alias("i")).first().i == want


def test_hosts(spark):
    cases = {" WWW.Example.com ": "www.example.com", "https://Ex.com:8080/p": "ex.com", " ": None, None: None}
    rows = spark.createDataFrame([(h,) for h in cases], "h string")
    assert {r.h: r.n for r in rows.select("h", U.normalize_host(F.col("h")).alias("n")).collect()} == cases


def test_language_rules(spark):
    cases = [
        ("fr", None, "fr"), ("en", None, "en"), ("jp", "https://a.example/en/", "ja"), ("eu", "https://a.example/en/", "en"),
        ("be", None, None), (" French Guiana", None, "fr"), (None, None, None), ("", "https://a.example/es/", "es"),
    ]
    rows = spark.createDataFrame(cases, "c string, u string, want string")
    got = rows.select("want", L.declared_language(F.col("c"), F.array("u")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    labels = {"pt": "pt", "ceb": "ceb", "port": "xx", "__label__FR": "fr", "x": "xx", " ": "xx"}
    rows = spark.createDataFrame([(x,) for x in labels], "l string")
    assert {r.l: r.n for r in rows.select("l", L.normalize_label(F.col("l")).alias("n")).collect()} == labels


def test_identity_and_keys(spark):
    texts = {"Éva  STRAẞE-Maß!": "eva strasse mass", "éa": "ea", "?!": None, "日本 2": "日本 2", None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.i for r in rows.select("t", identity_text(F.col("t")).alias("i")).collect()} == texts
    none = F.lit(None).cast("string")
    at = F.lit(None).cast("timestamp")
    key = lambda t, c: article_key(F.lit("u"), F.lit(t), F.array(F.lit("A b")), c, at)
    row = spark.range(1).select(
        (key("É!", none) == key("e", none)).alias("same"),
        (key("e", F.lit("c")) == key("e c", none)).alias("mixed"),
        content_key(F.lit("t"), F.lit(" ?"), none, at).alias("blank"),
        content_key(F.lit("t"), none, none, at).alias("missing"),
    )
    assert tuple(row.first()) == (True, False, None, None)


def test_references(spark):
    refs = {"rss:1:2": (1, 2, True), "rss:1": (None, None, False), "a:b:2": (None, None, False), "": (None, None, False)}
    rows = spark.createDataFrame([(r,) for r in refs], "r string")
    assert {r.r: tuple(r.p) for r in rows.select("r", parse_payload_ref(F.col("r")).alias("p")).collect()} == refs
    ids = spark.range(1).select(clean_ref_ids(F.array(*[F.lit(x) for x in ("3", "0", "-1", None, "x", "3")])).alias("i"))
    assert ids.first().i == [3, 3]
