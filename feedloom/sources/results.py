"""Result envelopes: JSON text to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.schemas import EVENT, RAW_ENVELOPE

_CORRUPT = "_corrupt"
_RULE = "array<struct<rule:string,event_pos:int,source_pos:int>>"
_WHOLE = r"^\s*[+-]?[0-9]+(\.0+)?\s*$"


def _kind(v: Column, path: str) -> Column:
    """Type of a JSON value: null where it is missing, ``VOID`` for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _items(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _wrong(rule: str, wrong: Column, event_pos: Column, source_pos: Column) -> Column:
    found = F.struct(F.lit(rule).alias("rule"), event_pos.cast("int").alias("event_pos"), source_pos.cast("int").alias("source_pos"))
    return F.when(F.coalesce(wrong, F.lit(False)), found)


def _no_text(v: Column, path: str, optional: bool = False) -> Column:
    """Whether a given value is something else than text (or, if optional, JSON null)."""
    return ~_kind(v, path).isin(["STRING", "VOID"] if optional else ["STRING"])


def _no_texts(v: Column, path: str) -> Column:
    items = _items(v, path)
    return _kind(v, path).isNotNull() & (items.isNull() | F.exists(items, lambda x: F.schema_of_variant(x) != "STRING"))


def _no_list(v: Column, path: str) -> Column:
    return _kind(v, path).isNotNull() & _items(v, path).isNull()


def _no_whole(v: Column, path: str) -> Column:
    kind, text = _kind(v, path), F.try_variant_get(v, path, "string")
    return (kind != "VOID") & ((kind == "BOOLEAN") | ~F.coalesce(text.rlike(_WHOLE), F.lit(False)))


def _source_types(s: Column, e: Column, p: Column) -> Column:
    return F.array(
        _wrong("source", ~_is_object(s), e, p),
        _wrong("title", _no_text(s, "$.title"), e, p),
        *[_wrong(c, _no_text(s, f"$.{c}", optional=True), e, p) for c in ("summary", "author", "image_url")],
        _wrong("url", _no_texts(s, "$.urls"), e, p),
        _wrong("authors", _no_texts(s, "$.authors"), e, p),
    )


def _event_types(v: Column, e: Column) -> Column:
    none = F.lit(None)
    own = F.array(
        _wrong("event", ~_is_object(v), e, none),
        _wrong("feed_id", _no_whole(v, "$.feed_id"), e, none),
        *[_wrong(c, _no_text(v, f"$.{c}"), e, none) for c in ("job_id", "status")],
        _wrong("status_code", _no_whole(v, "$.status_code"), e, none),
        _wrong("new_etag", _no_text(v, "$.new_etag", optional=True), e, none),
        _wrong("sources", _no_list(v, "$.sources"), e, none),
    )
    sources = F.flatten(F.transform(_items(v, "$.sources"), lambda s, p: _source_types(s, e, p)))
    return F.concat(own, F.coalesce(sources, F.array().cast(_RULE)))


def _type_errors(body: Column) -> Column:
    none = F.lit(None)
    own = F.array(
        _wrong("contract_version", _no_text(body, "$.contract_version"), none, none),
        _wrong("result_events", _no_list(body, "$.result_events"), none, none),
    )
    events = F.flatten(F.transform(_items(body, "$.result_events"), _event_types))
    return F.filter(F.concat(own, F.coalesce(events, F.array().cast(_RULE))), lambda x: x.isNotNull())


def _whole(text: Column, type_: str) -> Column:
    return F.when(text.rlike(_WHOLE), F.regexp_replace(F.trim(text), r"\.0+$", "").try_cast(type_))


def parse_results(raw: DataFrame, json_column: str = "body") -> DataFrame:
    """Typed envelopes from ``envelope_id`` and a JSON text column.

    Unreadable text keeps its row, with ``parse_error`` set, so that the contract check can quarantine it; so does text
    with anything behind the envelope. ``type_errors`` lists the values of a wrong JSON type, which the reader would
    turn into text, and JSON nulls where a list must be. Whole numbers may come as text.
    """
    parsed = F.from_json(F.col(json_column), f"{RAW_ENVELOPE}, {_CORRUPT} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    # As the only item of a list, an envelope with more text behind it is no JSON, or not the only item.
    listed = _items(F.try_parse_json(F.concat(F.lit("["), F.col(json_column), F.lit("]"))))
    events = F.transform(
        "_p.result_events",
        lambda e: e.withField("feed_id", _whole(e["feed_id"], "bigint")).withField("status_code", _whole(e["status_code"], "int")),
    )
    single = (F.size("_v") == 1) & _is_object(F.get("_v", 0))
    return raw.withColumn("_p", parsed).withColumn("_v", listed).select(
        *[c for c in raw.columns if c != json_column],
        "_p.contract_version",
        F.coalesce(events, F.array().cast(f"ARRAY<{EVENT}>")).alias("result_events"),
        "_p.local_dedup",
        (F.col("_p").isNull() | F.col(f"_p.{_CORRUPT}").isNotNull() | ~F.coalesce(single, F.lit(False))).alias("parse_error"),
        F.coalesce(_type_errors(F.get("_v", 0)), F.array().cast(_RULE)).alias("type_errors"),
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes from newline-delimited JSON files of ``{envelope_id, body}`` rows."""
    return parse_results(spark.read.schema("envelope_id BIGINT, body STRING").json(path))


def result_events(envelopes: DataFrame) -> DataFrame:
    """One row per result event, ``event_pos`` keeping the order within the envelope."""
    return envelopes.select("envelope_id", F.posexplode("result_events").alias("event_pos", "_e")).select(
        "envelope_id", "event_pos", "_e.*"
    )
