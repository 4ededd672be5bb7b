"""Author lists from bylines, as one expression per row.

Every step maps the array of fragments to a new array and mentions it once, so the expression grows
linearly with the number of steps, and no row leaves its partition. A byline shared by many articles
is therefore no hot key.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions import bylines as B
from feedloom.functions.text import identity_text, let


def _drop_parentheses(col: Column) -> Column:
    """Remove parenthesised chunks from the inside out, once per opening bracket at most."""
    opened = F.length(col) - F.length(F.replace(col, F.lit("("), F.lit("")))
    removed = F.aggregate(
        F.sequence(F.lit(1), F.greatest(opened, F.lit(1))),
        col,
        lambda text, _: F.trim(F.regexp_replace(text, rf"(?U){B.WS}*\([^()]*\)", "")),
    )
    return F.when(opened > 0, B.display(removed)).otherwise(B.display(col))


def _first_useful(parts: list[Column], accept, fallback: Column) -> Column:
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & accept(p))
    return F.coalesce(F.get(kept, 0), fallback)


def _left_of_with(col: Column) -> Column:
    sides = [B.display(F.regexp_extract(col, B.TRAILING_WITH, i)) for i in (1, 2)]
    return F.when(
        col.rlike(B.TRAILING_WITH), _first_useful(sides, lambda p: ~B.is_discardable(p), col)
    ).otherwise(col)


def _left_of(pattern: str, col: Column) -> Column:
    left = B.display(F.regexp_extract(col, pattern, 1))
    return F.when(col.rlike(pattern), _first_useful([left], B.is_named, col)).otherwise(col)


# One fragment, step by step; a null stays null.
_STEPS = [
    B.display,
    lambda c: B.display(F.regexp_replace(c, B.EDITORIAL_PREFIX, "")),
    lambda c: F.nullif(F.trim(F.regexp_replace(c, B.BYLINE_PREFIX, "")), F.lit("")),
    _drop_parentheses,
    lambda c: F.nullif(F.trim(F.regexp_replace(c, B.LEADING_WITH, "$1")), F.lit("")),
    _left_of_with,
    lambda c: _left_of(B.TRAILING_ROLE, c),
    lambda c: F.when(B.is_role(c), c).otherwise(_left_of(B.TRAILING_PLACE, c)),
    lambda c: F.when(~B.is_role(c) & B.has_descriptor(c), F.coalesce(B.leading_name(c), c)).otherwise(c),
    B.display,
    lambda c: F.when(~B.is_discardable(c), c),
]


def clean_fragments(fragments: Column) -> Column:
    """Each fragment as a display name, null where it names nobody."""
    for step in _STEPS:
        fragments = F.transform(fragments, step)
    return fragments


def _split(fragments: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(fragments, pattern), B.display), lambda p: p.isNotNull())


def _byline_names(byline: Column) -> Column:
    """Names of one byline in order."""
    prepared = F.regexp_replace(byline, B.INLINE_EDITORIAL, " ; ")
    # The whole list item first, then its conjunction parts; all are cleaned in one pass.
    items = F.transform(
        _split(prepared, B.LIST_SEPARATOR),
        lambda item: clean_fragments(F.concat(F.array(item), _split(item, B.CONJUNCTION))),
    )

    def choose(cleaned: Column) -> Column:
        parts = F.slice(cleaned, 2, F.size(cleaned) - 1)
        separable = (F.size(cleaned) > 2) & F.forall(parts, lambda p: F.coalesce(B.is_standalone(p), F.lit(False)))
        return F.when(separable, parts).otherwise(F.slice(cleaned, 1, 1))

    names = F.filter(F.flatten(F.transform(items, choose)), lambda n: n.isNotNull())
    return let(names, _drop_late_roles)


def _drop_late_roles(names: Column) -> Column:
    """A role label counts only while nobody has been named."""
    first_person = F.array_position(F.transform(names, lambda n: ~B.is_role(n)), True)
    return F.filter(names, lambda n, i: ~B.is_role(n) | (first_person == 0) | (i + 1 < first_person))


def _distinct_by_identity(names: Column) -> Column:
    keyed = F.filter(
        F.transform(names, lambda n: F.struct(n.alias("shown"), identity_text(n).alias("id"))),
        lambda n: n.id.isNotNull(),
    )

    def firsts(k: Column) -> Column:
        return let(
            F.transform(k, lambda n: n.id),
            lambda ids: F.filter(k, lambda n, i: F.array_position(ids, n.id) == i + 1),
        )

    return F.transform(let(keyed, firsts), lambda n: n.shown)


@lru_cache(maxsize=32)
def clean_authors(authors: str, author: str) -> Column:
    """Distinct author names of a source, in order, from its ``authors`` array and its ``author`` byline column.

    The expression is large, and streams ask for it in every batch, so it is kept per pair of column names.
    """
    bylines = F.filter(
        F.concat(F.coalesce(F.col(authors), F.array().cast("array<string>")), F.array(author)),
        lambda b: b.isNotNull(),
    )
    names = F.flatten(F.transform(bylines, _byline_names))
    # Removing one layer of wording may lay open the next, so names go through the steps again.
    cleaned = F.filter(clean_fragments(names), lambda n: n.isNotNull())
    return let(cleaned, _distinct_by_identity)
