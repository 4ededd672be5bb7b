"""Contract checks of result envelopes and completeness of result sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.keys import clean_ref_ids
from feedloom.operators.skew import hot_keys, salted_join

# Accepted result statuses and the limits of the result contract.
STATUSES = ["ok", "success", "not_modified", "error"]
MAX_CONTRACT_VERSION = 80
MAX_JOB_ID = 128
STATUS_CODES = (100, 599)
MAX_ETAG = 1024
MAX_TITLE = 2000
MAX_SUMMARY = 20000
MAX_URLS = 64
MAX_URL = 4000
MAX_AUTHOR = 255
MAX_IMAGE_URL = 4000

_VIOLATION = "array<struct<rule:string,event_pos:int,source_pos:int>>"


def _broken(rule: str, ok: Column, event_pos: Column, source_pos: Column) -> Column:
    entry = F.struct(
        F.lit(rule).alias("rule"), event_pos.cast("int").alias("event_pos"), source_pos.cast("int").alias("source_pos")
    )
    return F.when(~F.coalesce(ok, F.lit(False)), entry)


def _length_between(col: Column, low: int, high: int) -> Column:
    return F.length(col).between(low, high)


def _optional(col: Column, high: int) -> Column:
    return col.isNull() | (F.length(col) <= high)


def _source_rules(s: Column, e: Column, p: Column) -> Column:
    urls = s["urls"]
    return F.array(
        _broken("title", _length_between(s["title"], 1, MAX_TITLE), e, p),
        _broken("summary", _optional(s["summary"], MAX_SUMMARY), e, p),
        _broken("urls", F.size(urls).between(1, MAX_URLS), e, p),
        _broken(
            "url", urls.isNull() | F.forall(urls, lambda u: F.coalesce(_length_between(u, 1, MAX_URL), F.lit(False))), e, p
        ),
        _broken("author", _optional(s["author"], MAX_AUTHOR), e, p),
        _broken("authors", s["authors"].isNull() | F.forall(s["authors"], lambda a: a.isNotNull()), e, p),
        _broken("image_url", _optional(s["image_url"], MAX_IMAGE_URL), e, p),
    )


def _event_rules(v: Column, e: Column) -> Column:
    none = F.lit(None)
    own = F.array(
        _broken("feed_id", v["feed_id"] >= 1, e, none),
        _broken("job_id", _length_between(v["job_id"], 1, MAX_JOB_ID), e, none),
        _broken("status", v["status"].isin(STATUSES), e, none),
        _broken("status_code", v["status_code"].isNull() | v["status_code"].between(*STATUS_CODES), e, none),
        _broken("new_etag", _optional(v["new_etag"], MAX_ETAG), e, none),
    )
    sources = F.flatten(F.transform(v["sources"], lambda s, p: _source_rules(s, e, p)))
    return F.concat(own, F.coalesce(sources, F.array().cast(_VIOLATION)))


def violations(typed: bool = False) -> Column:
    """All broken rules of an envelope row as ``(rule, event_pos, source_pos)``, found without a shuffle.

    ``typed``: rows have ``type_errors``, as parsed from JSON; a rule broken in both ways counts once.
    """
    none = F.lit(None)
    envelope = F.array(
        _broken("parse", ~F.col("parse_error"), none, none),
        _broken("contract_version", _length_between(F.col("contract_version"), 1, MAX_CONTRACT_VERSION), none, none),
    )
    events = F.flatten(F.transform(F.col("result_events"), _event_rules))
    found = F.filter(F.concat(envelope, F.coalesce(events, F.array().cast(_VIOLATION))), lambda b: b.isNotNull())
    return F.array_distinct(F.concat(found, F.col("type_errors").cast(_VIOLATION))) if typed else found


def contract_violations(envelopes: DataFrame) -> DataFrame:
    """One row per broken rule of each parsed envelope."""
    found = envelopes.select("envelope_id", F.explode(violations("type_errors" in envelopes.columns)).alias("v"))
    return found.select("envelope_id", "v.rule", "v.event_pos", "v.source_pos")


def split_valid(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantine)``: one broken rule rejects the whole envelope."""
    judged = envelopes.withColumn("violations", violations("type_errors" in envelopes.columns)).drop("type_errors")
    broken = F.size("violations") > 0
    return judged.where(~broken).drop("violations"), judged.where(broken)


def completeness_violations(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Compare the feeds each task asked for with the result events it got.

    ``tasks`` has ``task_id, job_id, ref_ids``; ``events`` has ``task_id, job_id, feed_id``. Rules: ``no_refs``,
    ``missing``, ``unexpected``, ``duplicate`` and ``wrong_job``, the last with the number of events concerned.
    Events are counted per task and feed before anything is joined.
    """
    ids = tasks.select("task_id", F.col("job_id").alias("task_job"), clean_ref_ids(F.col("ref_ids")).alias("ids"))
    expected = ids.select("task_id", F.explode(F.array_distinct("ids")).alias("feed_id"), F.lit(True).alias("wanted"))
    counted = events.groupBy("task_id", "feed_id", "job_id").agg(F.count(F.lit(1)).alias("n"))
    # Events of unknown tasks drop out here.
    known = salted_join(
        counted,
        ids.select("task_id", "task_job"),
        "task_id",
        spread=["feed_id", "job_id"],
        how="inner",
        hot=hot_keys(events, "task_id"),
    )
    stray = ~F.col("job_id").eqNullSafe(F.col("task_job"))
    seen = known.groupBy("task_id", "feed_id").agg(F.sum("n").alias("n"))
    matched = expected.join(seen, ["task_id", "feed_id"], "full_outer")
    rules = F.array(
        F.when(F.col("n").isNull(), F.lit("missing")),
        F.when(F.col("wanted").isNull(), F.lit("unexpected")),
        F.when(F.col("n") > 1, F.lit("duplicate")),
    )
    broken = F.explode(F.filter(rules, lambda r: r.isNotNull()))
    by_feed = matched.select("task_id", "feed_id", broken.alias("rule"), F.coalesce("n", F.lit(0)).alias("n"))
    wrong_job = (
        known.where(stray)
        .groupBy("task_id")
        .agg(F.sum("n").alias("n"))
        .select("task_id", F.lit(None).cast("bigint").alias("feed_id"), F.lit("wrong_job").alias("rule"), "n")
    )
    no_refs = ids.where(F.coalesce(F.size("ids"), F.lit(0)) < 1).select(
        "task_id", F.lit(None).cast("bigint").alias("feed_id"), F.lit("no_refs").alias("rule"), F.lit(0).alias("n")
    )
    return reduce(DataFrame.unionByName, [by_feed, wrong_job, no_refs]).select(
        "task_id", "feed_id", "rule", F.col("n").cast("bigint").alias("n")
    )
