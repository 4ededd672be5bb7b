"""Language rules that need no text model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import UNKNOWN, fold, strip
from feedloom.functions.urls import first_url_hint

# Countries with one main language.
COUNTRY_LANGUAGES = {
    "fr": "fr", "it": "it", "de": "de", "es": "es", "pt": "pt", "nl": "nl", "pl": "pl",
    "se": "sv", "dk": "da", "no": "no", "fi": "fi", "gr": "el", "cz": "cs", "sk": "sk",
    "hu": "hu", "ro": "ro", "bg": "bg", "tr": "tr", "jp": "ja", "kr": "ko", "cn": "zh",
    "ru": "ru", "us": "en", "en": "en", "uk": "en", "gb": "en",
}

# Storable length of a language code.
MIN_CODE_LENGTH = 2
MAX_CODE_LENGTH = 3


def country_language(country: Column) -> Column:
    """Language of a country, read from the first two characters; null when the country is mixed or unknown."""
    table = F.create_map(*[F.lit(x) for pair in COUNTRY_LANGUAGES.items() for x in pair])
    return F.element_at(table, F.substring(fold(strip(country)), 1, 2))


def normalize_label(label: Column) -> Column:
    """A classifier label as a language code; labels that cannot be stored become unknown."""
    code = fold(strip(F.replace(label, F.lit("__label__"), F.lit(""))))
    return F.when(F.length(code).between(MIN_CODE_LENGTH, MAX_CODE_LENGTH), code).otherwise(F.lit(UNKNOWN))


def detection_text(title: Column, summary: Column) -> Column:
    """Title and summary as one line of text for a text model."""
    parts = [F.nullif(strip(part), F.lit("")) for part in (title, summary)]
    return F.translate(F.concat_ws("\n\n", *parts), "\n", " ")


def declared_language(country: Column, urls: Column) -> Column:
    """Language by country, else by URL hint, else null: the part of the cascade before the text model."""
    return F.coalesce(country_language(country), first_url_hint(urls))


def is_unknown(language: Column) -> Column:
    """Null, blank or the sentinel; written so that a Parquet scan can evaluate it."""
    return language.isNull() | language.isin("", UNKNOWN)
