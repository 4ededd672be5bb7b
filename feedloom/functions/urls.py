"""URL rules: canonical form, variants, image links, hosts and language hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import fold, let, strip

# Length limits of stored links.
IMAGE_URL_MAX_LENGTH = 1000
STORED_URL_MAX_LENGTH = 1000

# Language codes that a URL part may spell out.
URL_LANGUAGE_HINTS = ["en", "fr", "de", "nl", "it", "es", "pt"]

# scheme, user info, host, port, path, query of an absolute http(s) URL
_HTTP = (
    r"(?i)^(https?)://((?:[^/?#@\s]*@)?)(\[[0-9a-f:.]+\]|[^/?#:@\s\[\]]+)(?::([0-9]*))?"
    r"((?:/[^?#\s]*)?)((?:\?[^#\s]*)?)(?:#.*)?$"
)
# scheme, authority, path, query of any URI reference (RFC 3986, appendix B)
_ANY = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_PRIVATE_HOST = (
    r"(?i)^(localhost|.*\.localhost|.*\.local|127\..*|10\..*|192\.168\..*|169\.254\..*|0\..*"
    r"|172\.(1[6-9]|2[0-9]|3[01])\..*)$"
)


def _canonical(url: Column) -> Column:
    part = lambda n: F.regexp_extract(url, _HTTP, n)
    scheme = F.lower(part(1))
    is_default_port = ((scheme == "http") & (part(4) == "80")) | ((scheme == "https") & (part(4) == "443"))
    port = F.when((part(4) == "") | is_default_port, F.lit("")).otherwise(F.concat(F.lit(":"), part(4)))
    kept = F.array_join(
        F.filter(F.split(F.substr(part(6), F.lit(2)), "&"), lambda p: ~p.rlike("(?i)^utm_") & (p != "")), "&"
    )
    query = F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept))
    return F.when(url.rlike(_HTTP), F.concat(scheme, F.lit("://"), part(2), F.lower(part(3)), port, part(5), query))


def canonical_url(url: Column) -> Column:
    """Absolute http(s) URL with lower-case scheme and host and without fragment, default port or ``utm_*``.

    Anything else gives null.
    """
    return let(strip(url), _canonical)


def canonical_urls(urls: Column) -> Column:
    """The canonical forms of an array, in order, unusable entries dropped."""
    return F.filter(F.transform(urls, canonical_url), lambda u: u.isNotNull())


def primary_url(urls: Column) -> Column:
    """The first entry that has a canonical form."""
    return F.get(canonical_urls(urls), 0)


def url_variants(urls: Column) -> Column:
    """Distinct canonical forms in order, without those too long to store."""
    fits = lambda u: F.length(u) <= STORED_URL_MAX_LENGTH
    return F.array_distinct(F.filter(canonical_urls(urls), fits))


def image_url(url: Column) -> Column:
    """A public https link of storable length, else null."""
    clean = strip(url)
    host = F.regexp_extract(clean, _HTTP, 3)
    public = clean.rlike(_HTTP) & clean.rlike("(?i)^https:") & host.contains(".") & ~host.rlike(_PRIVATE_HOST)
    return F.when(public & (F.length(clean) <= IMAGE_URL_MAX_LENGTH), clean)


def _hostname(authority: Column) -> Column:
    """Host of ``user@host:port``, lower case; empty when there is none."""
    bare = F.regexp_replace(authority, "(?s)^.*@", "")
    return F.lower(F.regexp_extract(bare, r"(?s)^\[([^\]]*)\]|^([^:]*)", 0))


def normalize_host(host: Column) -> Column:
    """Lower-case host of a bare host or a URL; null when blank."""
    clean = strip(host)
    url = F.when(clean.contains("://"), clean).otherwise(F.concat(F.lit("//"), clean))
    name = F.regexp_replace(strip(_hostname(F.regexp_extract(url, _ANY, 2))), r"[\[\]]", "")
    return F.nullif(name, F.lit(""))


def _first_hint(tokens: Column) -> Column:
    return F.get(F.filter(tokens, lambda t: t.isin(URL_LANGUAGE_HINTS)), 0)


def _decoded(col: Column) -> Column:
    return F.coalesce(F.try_url_decode(col), col)


def _hint(url: Column) -> Column:
    host = F.transform(F.split(_hostname(F.regexp_extract(url, _ANY, 2)), "[.]"), lambda t: fold(strip(t)))
    path = F.transform(
        F.reverse(F.split(F.regexp_extract(url, _ANY, 3), "/")),
        lambda t: F.regexp_replace(
            F.regexp_replace(F.regexp_replace(fold(strip(t)), r"\.xml$", ""), r"\.rss$", ""), r"\.atom$", ""
        ),
    )
    pairs = F.split(F.regexp_extract(url, _ANY, 4), "&")
    query = F.flatten(
        F.transform(
            pairs,
            lambda p: F.transform(
                F.array(F.substring_index(p, "=", 1), F.regexp_extract(p, "(?s)=(.*)$", 1)),
                lambda t: fold(strip(_decoded(t))),
            ),
        )
    )
    return F.coalesce(_first_hint(host), _first_hint(path), _first_hint(query))


def url_language_hint(url: Column) -> Column:
    """Language spelled out by a URL: host labels left to right, path right to left, then the query."""
    return let(F.regexp_replace(strip(url), r"[\t\r\n]", ""), _hint)


def first_url_hint(urls: Column) -> Column:
    """Hint of the first URL that has one."""
    return F.get(F.filter(F.transform(urls, url_language_hint), lambda h: h.isNotNull()), 0)
