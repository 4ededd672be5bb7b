"""Feed health and the payloads that tell a worker what to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.keys import FETCH_TASK_PREFIX, clean_ref_ids
from feedloom.functions.urls import normalize_host
from feedloom.operators.skew import CHUNK_ROWS, chunk_of, measured_join, salted_join, since_reset

ERROR = "error"
# Constants of a fetch payload.
REQUESTED_BY = "jobs.rss_scrape"
DEFAULT_FETCH_PROTECTION = 1
STALE_CODE = "stale_reference"
REBUILD_FAILURES = "payload_rebuild_failures"


def latest_published(sources: Column) -> Column:
    """Newest ``published_at`` of a result's sources; null when none has one."""
    return F.array_max(F.transform(sources, lambda s: s["published_at"]))


def feed_runtime(results: DataFrame, previous: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One health row per feed after a batch of results.

    ``results``: ``feed_id, seq`` (dense, unique), ``at, status, status_code, etag, feed_update, article_at``. The
    error streak counts the errors after the last other status and continues ``previous`` when there was none.
    """
    failed = F.col("status") == ERROR
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))
    state = F.max(F.struct("seq", "at", "status", "status_code"))
    folded = since_reset(
        results,
        "feed_id",
        "seq",
        chunk_of("seq", chunk_rows),
        reset=~failed,
        tail={"errors": (F.sum, failed.cast("bigint"), F.sum)},
        whole={
            "state": (state, F.max),
            "etag": (last("etag"), F.max),
            "update": (last("feed_update"), F.max),
            "article": (last("article_at"), F.max),
        },
    )
    is_error = F.col("state.status") == ERROR
    new = folded.select(
        "feed_id",
        F.col("state.at").alias("last_scraped_at"),
        F.col("state.status").alias("last_status"),
        F.col("etag.etag").alias("etag"),
        F.col("update.feed_update").alias("last_feed_update"),
        F.col("article.article_at").alias("last_article_published_at"),
        F.coalesce("errors", F.lit(0)).alias("consecutive_error_count"),
        F.when(is_error, F.col("state.at")).alias("last_error_at"),
        F.when(is_error, F.col("state.status_code")).alias("last_error_code"),
        "has_reset",
    )
    if previous is None:
        return new.drop("has_reset")
    old = previous.select("feed_id", *[F.col(c).alias(f"_{c}") for c in previous.columns if c != "feed_id"])
    both = new.join(old, "feed_id", "full_outer")
    unseen = F.col("last_status").isNull()
    streak = F.col("consecutive_error_count") + F.when(
        F.col("has_reset"), F.lit(0)
    ).otherwise(F.coalesce("_consecutive_error_count", F.lit(0)))
    pick = lambda c, new_value: F.when(unseen, F.col(f"_{c}")).otherwise(new_value).alias(c)
    carry = lambda c: F.coalesce(c, f"_{c}").alias(c)
    return both.select(
        "feed_id",
        carry("last_scraped_at"),
        carry("last_status"),
        carry("etag"),
        carry("last_feed_update"),
        carry("last_article_published_at"),
        pick("consecutive_error_count", streak),
        pick("last_error_at", F.col("last_error_at")),
        pick("last_error_code", F.col("last_error_code")),
    )


def _is_fetch(tasks: DataFrame) -> Column:
    """Whether a task asks for feeds by its ``task_type``; without that column all do."""
    if "task_type" not in tasks.columns:
        return F.lit(True)
    return F.coalesce(F.col("task_type").startswith(FETCH_TASK_PREFIX), F.lit(False))


def _wanted(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks with cleaned references, and one row per requested feed in order."""
    requested = tasks.select("task_id", "job_id", "requested_at", clean_ref_ids(F.col("ref_ids")).alias("ref_ids"))
    return requested, requested.select("task_id", F.posexplode("ref_ids").alias("pos", "feed_id"))


def _with_url(feeds: DataFrame) -> DataFrame:
    return feeds.where(F.col("url").isNotNull()).withColumnRenamed("id", "feed_id")


def feed_payloads(
    tasks: DataFrame,
    feeds: DataFrame,
    companies: DataFrame,
    runtime: DataFrame,
    hot: dict[int, int] | None = None,
) -> DataFrame:
    """What to fetch for each task: ``task_id, payload``.

    ``tasks`` has ``task_id, job_id, requested_at, ref_ids``. A payload lists the requested feeds in order. Tasks whose
    feeds cannot be rebuilt exactly have none; see :func:`stale_tasks`. With a column ``task_type`` only fetch tasks have one.
    """
    requested, wanted = _wanted(tasks.where(_is_fetch(tasks)))
    company = companies.select(
        F.col("id").alias("company_id"), F.col("host").alias("_host"), F.col("fetchprotection").alias("_protection")
    )
    state = runtime.select("feed_id", "etag", "last_feed_update", "last_article_published_at")
    protection = F.when(F.coalesce("_protection", F.lit(0)) == 0, F.lit(DEFAULT_FETCH_PROTECTION))
    feed = (
        _with_url(feeds)
        .join(company, "company_id", "left")
        .join(state, "feed_id", "left")
        .select(
            "feed_id",
            F.struct(
                "feed_id",
                F.col("url").alias("feed_url"),
                "company_id",
                normalize_host(F.col("_host")).alias("host_header"),
                protection.otherwise(F.col("_protection")).alias("fetchprotection"),
                "etag",
                F.col("last_feed_update").alias("last_update"),
                F.col("last_article_published_at").alias("last_db_article_published_at"),
            ).alias("feed"),
        )
    )
    found = salted_join(wanted, feed, "feed_id", spread=["task_id", "pos"], how="inner", hot=hot)
    # A list is no longer than one task's own reference array.
    lists = found.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("pos", "feed"))).alias("_feeds"))
    complete = requested.join(lists, "task_id").where(F.size("_feeds") == F.size("ref_ids"))
    return complete.select(
        "task_id",
        F.struct(
            "job_id",
            "requested_at",
            F.lit(True).alias("ingest"),
            F.lit(REQUESTED_BY).alias("requested_by"),
            F.transform("_feeds", lambda f: f["feed"]).alias("feeds"),
        ).alias("payload"),
    )


def payload_lines(payloads: DataFrame) -> DataFrame:
    """``(task_id, value)``: each payload as one line of JSON, for a text sink."""
    return payloads.select("task_id", F.to_json("payload", {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"}).alias("value"))


def stale_tasks(tasks: DataFrame, feeds: DataFrame, hot: dict[int, int] | None = None) -> DataFrame:
    """Tasks that ask for no feed, or for one that is gone or has no URL, with the number of such feeds.

    Found feeds are a subset of the requested positions, so the lists agree exactly when their lengths do. With a column
    ``task_type`` tasks of other types than fetching are listed as ``unsupported_type``, whatever they refer to.
    """
    requested, wanted = _wanted(tasks.where(_is_fetch(tasks)))
    known = _with_url(feeds).select("feed_id")
    found = measured_join(wanted, known, "feed_id", spread=["task_id", "pos"], how="inner", hot=hot)
    counts = found.groupBy("task_id").agg(F.count(F.lit(1)).alias("_found"))
    size = F.coalesce(F.size("ref_ids"), F.lit(0))
    missing = size - F.coalesce("_found", F.lit(0))
    stale = requested.join(counts, "task_id", "left").where((size < 1) | (missing > 0)).select(
        "task_id",
        "job_id",
        F.when(size < 1, F.lit("no_refs")).otherwise(F.lit("feed_missing")).alias("reason"),
        F.greatest(missing, F.lit(0)).cast("bigint").alias("missing_feeds"),
    )
    if "task_type" not in tasks.columns:
        return stale
    other = tasks.where(~_is_fetch(tasks)).select(
        "task_id", "job_id", F.lit("unsupported_type").alias("reason"), F.lit(0).cast("bigint").alias("missing_feeds")
    )
    return stale.unionByName(other)


def stale_outcomes(stale: DataFrame, tasks: DataFrame, seq: str, at: Column) -> DataFrame:
    """Failed outcome reports, as :func:`feedloom.operators.jobs.task_outcomes` reads them, of stale fetch tasks.

    ``stale`` is the result of :func:`stale_tasks`, ``tasks`` (unique on ``task_id``) has ``execution_id``, ``item_total`` and
    the column named ``seq``. All items of a stale task count as errors; tasks of an unsupported type get no report.
    """
    failed = stale.where(F.col("reason") != "unsupported_type").select("task_id", "reason")
    return failed.join(tasks.select("task_id", "execution_id", "item_total", F.col(seq).alias("seq")), "task_id").select(
        "seq",
        "task_id",
        "execution_id",
        F.lit("failed").alias("outcome"),
        at.alias("at"),
        F.lit(0).cast("bigint").alias("item_success"),
        F.col("item_total").cast("bigint").alias("item_error"),
        F.concat_ws(": ", F.lit(STALE_CODE), "reason").alias("error_message"),
    )


def rebuild_failures(stale: DataFrame) -> DataFrame:
    """Increments for :func:`feedloom.operators.workers.runtime_counters`: one for each stale fetch task."""
    failed = stale.where(F.col("reason") != "unsupported_type")
    return failed.select(F.lit(REBUILD_FAILURES).alias("counter_name"), F.lit(1).cast("bigint").alias("amount"))


def feed_silences(results: DataFrame, hours: int, as_of: Column) -> DataFrame:
    """The times up to ``as_of`` at which a feed had given no result for more than ``hours``, and what came before.

    ``results``: ``feed_id, at, status``; those after ``as_of`` or without a time are not seen. One row per silence: ``feed_id``,
    ``active_from`` (first result since the silence before), ``last_result_at``, ``silent_at`` (``hours`` later), and the number
    of ``results`` and ``errors`` between the first two. Two results with more than ``hours`` between them have a silence.

    Results are folded by feed and stretches of ``hours`` first, inside which no silence fits. So a busy feed moves one row
    per stretch and task, and what meets per feed grows with the time covered, not with the results.
    """
    width = F.make_dt_interval(hours=F.lit(hours))
    seen = results.where(F.col("at") <= as_of)
    stretches = seen.groupBy("feed_id", F.window(F.col("at").cast("timestamp"), f"{hours} hours").alias("_stretch")).agg(
        F.min("at").alias("_first"),
        F.max("at").alias("_last"),
        F.count(F.lit(1)).alias("_results"),
        F.count_if(F.col("status") == ERROR).alias("_errors"),
    )
    order = Window.partitionBy("feed_id").orderBy("_first")
    resumed = F.coalesce(F.col("_first") > F.lag("_last").over(order) + width, F.lit(False))
    active = stretches.withColumn("_resumed", resumed).withColumn("_spell", F.count_if("_resumed").over(order))
    spells = active.groupBy("feed_id", "_spell").agg(
        F.min("_first").alias("active_from"),
        F.max("_last").alias("last_result_at"),
        F.sum("_results").alias("results"),
        F.sum("_errors").alias("errors"),
    )
    told = spells.drop("_spell").withColumn("silent_at", F.col("last_result_at") + width)
    return told.where(F.col("silent_at") <= as_of)
