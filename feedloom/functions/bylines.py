"""Author bylines: fixed patterns and word lists, and boolean tests on one fragment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import ACCENTED, UNACCENTED, WS, identity_text, let, plain_text

_I = "(?iU)"

# Separators and phrases of bylines.
LIST_SEPARATOR = rf"{_I}{WS}*[;,]{WS}*"
CONJUNCTION = rf"{_I}{WS}*(?:&|\band\b|\bet\b){WS}*"
INLINE_EDITORIAL = rf"{_I}\bedited by\b|\bexecutive producers? are\b|\bexecutive producer is\b"
EDITORIAL_PREFIX = (
    rf"{_I}^(?:(?:de notre|notre|propos recueillis par|recueilli(?:e|es|s)? par|reported by"
    rf"|text(?:{WS}+by)?|texte(?:{WS}+de)?){WS}+)+"
)
BYLINE_PREFIX = rf"{_I}^(?:(?:par|by){WS}+)+"
WITH_WORDS = "(?:avec|with)"
ROLE_WORDS = (
    "(?:correspondance|correspondante?|correspondent|special correspondent"
    "|envoy(?:e|é)e?" + WS + "+sp(?:e|é)ciale?)"
)
PLACE_WORDS = "(?:in|at|a|à|au|aux|en|dans|depuis|sur)"
GENERIC_DESK = (
    rf"{_I}^(?:a|an|the|un|une|le|la|les){WS}+.+\b"
    r"(?:reporter|editor|staff|team|desk|bureau|newsroom|redaction|rédaction|editorial)\b.*$"
)
DOMAIN = (
    rf"{_I}(?:^|[\s(])(?:www\.)?[a-z0-9-]+\.(?:com|fr|org|net|io|co|info|tv|fm|be|ch|de|uk|eu)(?:$|[\s)])"
)
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
NAME_WORD = rf"^[{LETTERS}]+(?:[-'’][{LETTERS}]+)*$"
INITIALS = rf"^(?:[{LETTERS}]\.)+(?:-[{LETTERS}]\.)*$"

# Words that announce a place, as identity text.
PLACE_PREFIXES = ["in", "at", "a", "au", "aux", "en", "dans", "depuis", "sur"]
# Particles that may stand inside a name.
PARTICLES = ["de", "du", "des", "del", "della", "di", "da", "van", "von", "bin", "ibn", "al", "la", "le"]
# Words that end a name, as identity text.
CUTOFF_WORDS = [
    "aumonier", "aumoniere", "diocese", "dioceses", "diocese de", "diocese d", "editor", "editors",
    "edited", "executive", "producer", "producers", "reporter", "regional", "regionale", "special",
    "speciale", "speciales", "specialiste", "correspondance", "correspondant", "correspondante",
    "hospital", "hopital", "bureau",
]
# Fixed value: longest single upper-case word taken for an agency name.
AGENCY_MAX_LENGTH = 10

_SEP = rf"(?:{WS}*[,/-]{WS}*|{WS}+)"
TRAILING_ROLE = rf"{_I}^(.+?){_SEP}{ROLE_WORDS}\b.*$"
TRAILING_PLACE = rf"{_I}^(.+?){_SEP}{PLACE_WORDS}{WS}+.+$"
LEADING_WITH = rf"{_I}^{WITH_WORDS}{WS}+(.+)$"
TRAILING_WITH = rf"{_I}^(.+?){WS}+{WITH_WORDS}{WS}+(.+)$"
ROLE = rf"{_I}^{ROLE_WORDS}\b"
ROLE_PLACE = rf"{_I}^{ROLE_WORDS}{WS}+{PLACE_WORDS}{WS}+.+$"


def display(col: Column) -> Column:
    """Single-spaced text without outer quotes; null when empty."""
    spaced = F.trim(F.regexp_replace(col, rf"(?U){WS}+", " "))
    return F.nullif(F.trim(F.trim(spaced, F.lit("\"'"))), F.lit(""))


# Anything but a letter, a digit or a space; identity text drops it.
_OTHER = r"[^\p{L}\p{N} ]"


def _any_of(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace(" ", f"{_OTHER}+") for w in words) + ")"


# One word of a list, and a listed word after the first word, on plain text; words may carry punctuation.
_PLACE = rf"^{_OTHER}*{_any_of(PLACE_PREFIXES)}{_OTHER}*$"
_PARTICLE = rf"^{_OTHER}*{_any_of(PARTICLES)}{_OTHER}*$"
_ENDING = _any_of(CUTOFF_WORDS + PLACE_PREFIXES)
_ENDS_NAME = rf"^{_OTHER}*{_ENDING}{_OTHER}*$|^{_OTHER}*$"
_DESCRIPTOR = rf"^[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}].* {_OTHER}*{_ENDING}{_OTHER}*(?: |$)"


def is_role(col: Column) -> Column:
    return col.rlike(ROLE)


def is_place(col: Column) -> Column:
    """``in Paris``: at least two words, the first a lower-case place word."""
    first = F.substring_index(col, " ", 1)
    return col.contains(" ") & (first == F.lower(first)) & plain_text(first).rlike(_PLACE)


# Only a fragment whose first letter is some kind of t can have the identity text of the word.
_MAYBE_TEXT = r"^[^\p{L}\p{N}]*[tT" + "".join(
    c + c.upper() for c, bare in zip(ACCENTED, UNACCENTED) if bare == "t" and len(c.upper()) == 1
) + "]"


def is_discardable(col: Column) -> Column:
    """Fragments that name nobody: a bare role, a desk, a domain, a place."""
    return (
        (col.rlike(_MAYBE_TEXT) & F.coalesce(identity_text(col) == "text", F.lit(False)))
        | (is_role(col) & ~col.rlike(ROLE_PLACE))
        | col.rlike(GENERIC_DESK)
        | col.rlike(DOMAIN)
        | is_place(col)
    )


def is_standalone(col: Column) -> Column:
    """Two words or more, or one short upper-case word such as an agency."""
    letters = F.length(F.regexp_replace(col, "[^A-Za-z0-9]+", ""))
    agency = (col == F.upper(col)) & letters.between(1, AGENCY_MAX_LENGTH)
    return ~is_discardable(col) & (col.contains(" ") | agency)


def is_named(col: Column) -> Column:
    return ~is_role(col) & is_standalone(col)


def has_descriptor(col: Column) -> Column:
    """A later word is one that ends a name."""
    return plain_text(col).rlike(_DESCRIPTOR)


def leading_name(col: Column) -> Column:
    """The name words before the first descriptor; particles count inside the name but not at its end."""
    tokens = F.filter(
        F.transform(F.split(col, " "), lambda t: F.regexp_replace(t, "^[,;:/]+|[,;:/]+$", "")), lambda t: t != ""
    )
    words = F.transform(
        tokens,
        lambda t, i: let(
            plain_text(t),
            lambda p: F.struct(
                t.alias("text"),
                (p.rlike(_PARTICLE) & (i > 0)).alias("inner"),
                p.rlike(_PARTICLE).alias("particle"),
                t.rlike(rf"{NAME_WORD}|{INITIALS}").alias("wordlike"),
                p.rlike(_ENDS_NAME).alias("ends"),
            ),
        ),
    )

    def cut(w: Column) -> Column:
        stops = F.transform(w, lambda x: x.ends | ~(x.inner | x.wordlike))
        stop = F.array_position(stops, True)
        return F.when(stop > 0, F.slice(w, 1, (stop - 1).cast("int"))).otherwise(w)

    def join(w: Column) -> Column:
        solid = F.array_position(F.reverse(F.transform(w, lambda x: ~x.particle)), True)
        size = F.when(solid > 0, F.size(w) - solid + 1).otherwise(F.lit(0)).cast("int")
        named = F.exists(w, lambda x: x.wordlike & ~x.inner)
        return F.when(named, display(F.array_join(F.transform(F.slice(w, 1, size), lambda x: x.text), " ")))

    return let(let(words, cut), join)
