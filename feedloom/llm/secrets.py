r"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong matches stand for themselves: assignments of a value of eight characters, access identifiers, long hex runs. Weak
parts are common in clean text and are reported only in company: an identifier (user, login or key name with a value, or
an access identifier cut short) and a secret (a short assigned value, a medium hex run, a mixed-case token with digits)
within ``SCOPE`` code points of each other, and an endpoint (address or host) with one of each within its scope.

Positions count code points; matches are found by splitting the text at them and adding up lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import small_side, stored, unused

#: Furthest distance, in code points, between parts of one credential.
SCOPE = 200
# Kinds in the order in which spans that start together are listed.
_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?-i:[A-Za-z0-9+/_.=-]+)"""
_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
_STRONG = {"assign": _ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
# Possessive runs and look-behinds keep each pattern linear in the length of a run.
_WEAK = {
    "identifier": r"""(?i)\b(?:user(?:_?name|_?id)?|login|client_?id|account_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}|(?-i:AKIA[A-Z0-9]{4,11}(?![A-Z0-9]))""",
    "secret": r"(?<![0-9a-f])[0-9a-f]{16,31}(?![0-9a-f])|(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]{0,64}[0-9])(?=[A-Za-z0-9+/_-]{0,64}[A-Z])(?=[A-Za-z0-9+/_-]{0,64}[a-z])[A-Za-z0-9+/_-]{20,}+",
    "endpoint": r"https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b|(?i:\b(?:host|hostname|server|endpoint)\b[\"']?\x20*[:=]\x20*[\"']?[a-z0-9.-]{3,})",
}
_KINDS = [*_STRONG, "identifier", "secret", "endpoint"]
_SPAN = "array<struct<start:int,rank:int,end:int,size:int>>"


def _found(pattern: str, rank: int, text: Column, hint: str) -> Column:
    """Spans of all matches in ``text``; ``hint`` is a cheaper pattern that a matching text must hold."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))
    size = F.length
    sizes = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(
        size(g).alias("gap"), size(h).alias("n"), size(F.regexp_replace(h, F.lit(_VALUE), F.lit(""))).alias("value")))
    spans = F.aggregate(
        sizes, zero,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"),
                                                    (acc["at"] + x["gap"] + x["n"]).alias("end"), x["value"].alias("size")))).alias("spans")),
        lambda acc: acc["spans"],
    )
    return F.when(text.rlike(hint), spans).otherwise(F.array().cast(_SPAN))


def _scan(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Columns ``keep`` as ``k0``, ..., a row number, the strong ``base`` spans and the ``weak`` candidates of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    hints = {"assign": r"(?i)(?:ssword|sswd|secret|token|api_?key)", "identifier": r"(?i)(?:user|login|client|account|access|AKIA)",
             "endpoint": r"(?i)(?:https?://|[0-9]\.[0-9]|host|server|endpoint)"}
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], body.alias("body"), F.monotonically_increasing_id().alias("row"))
    strong = [_found(p, _KINDS.index(k), F.col("body"), hints.get(k, p)) for k, p in _STRONG.items()]
    weak = [_found(p, _KINDS.index(k), F.col("body"), hints.get(k, p)) for k, p in _WEAK.items()]
    rows = rows.select("row", *[f"k{i}" for i in range(len(keep))], strong[0].alias("assign"), F.concat(*strong[1:]).alias("rest"), F.concat(*weak).alias("weak"))
    short = F.transform(F.filter("assign", lambda s: (s["size"] >= 4) & (s["size"] < 8)), lambda s: s.withField("rank", F.lit(_KINDS.index("secret"))))
    return rows.select(
        "row", *[f"k{i}" for i in range(len(keep))],
        F.concat(F.filter("assign", lambda s: s["size"] >= 8), "rest").alias("base"), F.concat("weak", short).alias("weak"),
    )


def _linked(rows: DataFrame) -> DataFrame:
    """``row`` and ``added``: the weak spans of a row with complementary parts within the scope, unless a strong span covers them.

    An interval join by sorting: along a document the furthest end of the parts before and the nearest start of the parts
    behind are carried in two passes, one from either side, so no pair of parts is ever built.
    """
    id_, secret, endpoint = (_KINDS.index(k) for k in ("identifier", "secret", "endpoint"))
    some = rows.where(F.size("weak") > 0)
    parts = some.select("row", F.explode(F.concat(
        F.transform("base", lambda s: s.withField("weak", F.lit(False))), F.transform("weak", lambda s: s.withField("weak", F.lit(True))),
    )).alias("s")).select("row", "s.*")
    roles = {"i": F.col("rank").isin(_KINDS.index("access"), id_), "s": F.col("rank").isin(_KINDS.index("assign"), _KINDS.index("hex"), secret)}
    strong = ~F.col("weak")
    ahead = Window.partitionBy("row").orderBy("start", "end", "rank").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    for role, is_ in roles.items():
        parts = parts.withColumn(f"{role}_end", F.max(F.when(is_, F.col("end"))).over(ahead))
    parts = parts.withColumn("cover_a", F.max(F.when(strong, F.col("end"))).over(ahead))
    for role, is_ in roles.items():
        parts = parts.withColumn(f"{role}_start", F.min(F.when(is_, F.col("start"))).over(behind))
    parts = parts.withColumn("cover_b", F.min(F.when(strong, F.struct("start", "end"))).over(behind))

    def near(role: str) -> Column:
        return F.coalesce(F.col("start") - F.col(f"{role}_end") <= SCOPE, F.lit(False)) | F.coalesce(F.col(f"{role}_start") - F.col("end") <= SCOPE, F.lit(False))

    # A strong span that starts before and ends behind this one's start, or starts inside it, says it all.
    overlapped = F.coalesce(F.col("cover_a") > F.col("start"), F.lit(False)) | F.coalesce(F.col("cover_b.start") < F.col("end"), F.lit(False))
    told = (
        F.when(F.col("rank") == id_, near("s")).when(F.col("rank") == secret, near("i"))
        .when(F.col("rank") == endpoint, near("i") & near("s"))
    )
    chosen = parts.where(F.col("weak") & told & ~overlapped)
    return chosen.groupBy("row").agg(F.collect_set(F.struct("start", "rank", "end", "size")).alias("added"))


def find_secrets(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with ``base`` and ``spans``, arrays of (``start``, ``rank``, ``end``, ``size``) in order.

    Repeated rows are scanned one by one. A null text is empty and has no spans.
    """
    rows = stored(_scan(docs, keep, text))
    added = F.coalesce("added", F.array().cast(_SPAN))
    out = rows.join(small_side(stored(_linked(rows)), 256), "row", "left").withColumn("spans", F.array_sort(F.concat("base", added)))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.array_sort("base").alias("base"), "spans")


def listed(spans: str) -> Column:
    kinds = F.array(*map(F.lit, _KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the strong kinds, the digest of their list, and the list of all spans, of every row."""
    found = find_secrets(docs, ["doc_id"])

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(_STRONG)]
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text", mask: str = "[REDACTED]", key: str = "doc_id") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mask``, overlapping spans by one; a null text stays null.

    Spans come back to their rows by id and text hash, so texts without spans do not move where the list is small.
    """
    print_ = F.xxhash64(text)
    id_, hash_, spans = unused(docs, "_id", "_print", "_spans")
    found = find_secrets(docs.select(F.col(key).alias(id_), print_.alias(hash_), F.col(text).alias("_body")), [id_, hash_], "_body")
    found = stored(found.where(F.size("spans") > 0).select(id_, hash_, F.col("spans").alias(spans)).dropDuplicates([id_, hash_]))
    rows = docs.join(small_side(found, 512), docs[key].eqNullSafe(found[id_]) & (print_ == found[hash_]), "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    joined = F.aggregate(
        spans, zero,
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(
                F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    )
    return rows.withColumn(text, F.coalesce(joined, F.col(text))).select(docs.columns)
