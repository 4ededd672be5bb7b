"""Text normalization shared by keys, authors and language rules."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the ASCII separators, which Java's \s leaves out.
WS = r"[\s\x1c-\x1f]"
UNKNOWN = "xx"


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their bare letters, from Unicode decompositions."""
    marked, bare = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = unicodedata.normalize("NFKD", char)[0]
        if char == char.lower() and base != char and base.isascii() and base.isalpha():
            marked.append(char)
            bare.append(base.lower())
    return "".join(marked), "".join(bare)


ACCENTED, UNACCENTED = _accent_table()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(col: Column) -> Column:
    """Trim Unicode white space."""
    return F.regexp_replace(col, f"(?U)^{WS}+|{WS}+$", "")


def blank_to_null(col: Column) -> Column:
    return F.when(strip(col) != "", col)


def known_or_unknown(col: Column) -> Column:
    """Null or empty becomes the sentinel for an unknown country or language."""
    return F.when(col != "", col).otherwise(F.lit(UNKNOWN))


def fold(col: Column) -> Column:
    """Lower case with the sharp s spelled out."""
    return F.replace(F.lower(col), F.lit("ß"), F.lit("ss"))


def plain_text(col: Column) -> Column:
    """Lower case without accents; the costly part runs only on text beyond ASCII."""
    unmarked = F.regexp_replace(F.translate(fold(col), ACCENTED, UNACCENTED), r"\p{M}+", "")
    return F.when(col.rlike(r"[^\x00-\x7f]"), unmarked).otherwise(F.lower(col))


def identity_text(col: Column) -> Column:
    """Case-, accent- and punctuation-free form used to compare names; null when nothing is left."""
    words = F.trim(F.regexp_replace(plain_text(col), r"[^\p{L}\p{N}]+", " "))
    return F.nullif(words, F.lit(""))
