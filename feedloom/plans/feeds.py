"""Queries on feed health, fetch payloads and result quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.keys import clean_ref_ids
from feedloom.operators import feeds as O
from feedloom.operators import quality as Q
from feedloom.operators.jobs import result_counts as result_counts_of
from feedloom.operators.jobs import task_outcomes
from feedloom.operators.workers import runtime_counters
from feedloom.plans import mapping as M
from feedloom.plans.registry import query, sql_stamp, stamp, table
from feedloom.session import cut_lineage
from feedloom.sources.results import parse_results


def runtime_results(events: DataFrame) -> DataFrame:
    """User events as results of a feed per user."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").alias("feed_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("at"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "not_modified").otherwise("success").alias("status"),
        (k + 400).alias("status_code"),
        F.when(k % 3 != 0, F.concat(F.lit("etag"), k)).alias("etag"),
        F.when(k % 4 == 0, F.col("ts")).alias("feed_update"),
        F.when(F.col("event_type") == "purchase", F.col("ts") - F.make_dt_interval(k)).alias("article_at"),
    )


RUNTIME_SQL = f"""
    WITH results AS (
        SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
            max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id) AS ok_id,
            max(event_id) OVER (PARTITION BY user_id) AS last_id FROM events)
    SELECT user_id AS feed_id, {sql_stamp('arg_max(ts, event_id)')} AS last_scraped_at,
        arg_max(CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'not_modified' ELSE 'success' END, event_id) AS last_status,
        arg_max(concat('etag', k), event_id) FILTER (k % 3 <> 0) AS etag,
        {sql_stamp('arg_max(ts, event_id) FILTER (k % 4 = 0)')} AS last_feed_update,
        {sql_stamp("arg_max(ts - k * INTERVAL 1 DAY, event_id) FILTER (event_type = 'purchase')")} AS last_article_published_at,
        count(*) FILTER (event_id > coalesce(ok_id, -1)) AS consecutive_error_count,
        {sql_stamp("max(ts) FILTER (event_id = last_id AND event_type = 'error')")} AS last_error_at,
        max(k + 400) FILTER (event_id = last_id AND event_type = 'error') AS last_error_code
    FROM results GROUP BY user_id
"""


def show_runtime(runtime: DataFrame) -> DataFrame:
    times = ["last_scraped_at", "last_feed_update", "last_article_published_at", "last_error_at"]
    return runtime.withColumns({c: stamp(c) for c in times})


SILENT_HOURS = 24


def silences_sql(seen: str, told: str | None = None) -> str:
    """Silences up to ``told``, from the results up to ``seen``."""
    return f"""
    WITH spoken AS (
        SELECT user_id AS feed_id, ts, event_type = 'error' AS failed,
            ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL {SILENT_HOURS} HOUR AS resumed
        FROM events WHERE ts <= {seen}),
    spells AS (SELECT *, count(*) FILTER (resumed) OVER (PARTITION BY feed_id ORDER BY ts) AS spell FROM spoken)
    SELECT feed_id, {sql_stamp('min(ts)')} AS active_from, {sql_stamp('max(ts)')} AS last_result_at,
        {sql_stamp(f'max(ts) + INTERVAL {SILENT_HOURS} HOUR')} AS silent_at, count(*) AS results, count(*) FILTER (failed) AS errors
    FROM spells GROUP BY feed_id, spell HAVING max(ts) + INTERVAL {SILENT_HOURS} HOUR <= {told or seen}"""


def show_silences(silences: DataFrame) -> DataFrame:
    return silences.withColumns({c: stamp(c) for c in ("active_from", "last_result_at", "silent_at")})


@query("feed_silences", silences_sql("TIMESTAMP '2024-01-20'"))
def feed_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = runtime_results(table(spark, sf_dir, "events"))
    return show_silences(O.feed_silences(results, SILENT_HOURS, F.lit("2024-01-20").cast("timestamp_ntz")))


@query("feed_runtime", RUNTIME_SQL)
def feed_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_runtime(O.feed_runtime(runtime_results(table(spark, sf_dir, "events"))))


@query(
    "latest_published",
    f"""SELECT doc_id AS event_seq, CASE WHEN doc_id % 7 <> 0 THEN {sql_stamp("TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE")} END
        AS latest FROM documents""",
)
def latest_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.result_events(spark, sf_dir).select("event_seq", stamp(O.latest_published(F.col("sources"))).alias("latest"))


def _order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks asking for the parts of their line items, in part order; orders without items ask for none.

    The frame stands for a stored task table, so it is written once and read by each use.
    """
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").groupBy("l_orderkey")
    ids = parts.agg(F.sort_array(F.collect_set("l_partkey")).alias("ref_ids")).withColumnRenamed("l_orderkey", "o_orderkey")
    tasks = table(spark, sf_dir, "orders").join(ids, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("task_id"),
        F.concat(F.lit("job"), "o_custkey").alias("job_id"),
        F.col("o_orderdate").alias("requested_at"),
        "ref_ids",
    )
    return cut_lineage(tasks)


def _part_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as feeds; some have no URL, some belong to no company."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 50 != 0, F.concat(F.lit("https://f.example/"), "p_partkey")).alias("url"),
        F.when(F.col("p_size") < 40, F.col("p_size")).cast("bigint").alias("company_id"),
    )


_REFS = """
    refs AS (SELECT DISTINCT l_orderkey AS task_id, l_partkey AS feed_id FROM lineitem WHERE l_partkey > 0),
    tasks AS (
        SELECT o_orderkey AS task_id, o_custkey, o_orderdate, count(r.feed_id) AS wanted,
            count(r.feed_id) FILTER (p_partkey % 50 <> 0) AS found
        FROM orders LEFT JOIN refs r ON r.task_id = o_orderkey LEFT JOIN part ON p_partkey = r.feed_id GROUP BY ALL)
"""


@query(
    "feed_payload",
    f"""WITH {_REFS}, runtime AS ({RUNTIME_SQL})
        SELECT t.task_id, concat('job', any_value(o_custkey)) AS job_id, {sql_stamp('any_value(o_orderdate)')} AS requested_at,
            true AS ingest, 'jobs.rss_scrape' AS requested_by,
            string_agg(concat_ws('|', r.feed_id, concat('https://f.example/', r.feed_id), coalesce(CAST(CASE WHEN p_size < 40 THEN p_size END AS VARCHAR), '-'),
                coalesce(lower('www.' || n_name || '.example'), '-'),
                CASE WHEN n_nationkey IS NULL OR n_nationkey % 4 < 2 THEN 1 ELSE n_nationkey % 4 - 1 END,
                coalesce(etag, '-'), coalesce(last_feed_update, '-'), coalesce(last_article_published_at, '-')), ' ; ' ORDER BY r.feed_id) AS feeds
        FROM tasks t JOIN refs r USING (task_id) JOIN part ON p_partkey = r.feed_id
            LEFT JOIN nation ON n_nationkey = CASE WHEN p_size < 40 THEN p_size END LEFT JOIN runtime u ON u.feed_id = r.feed_id
        WHERE wanted = found GROUP BY t.task_id""",
)
def feed_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    runtime = O.feed_runtime(runtime_results(table(spark, sf_dir, "events")))
    payloads = O.feed_payloads(
        _order_parts(spark, sf_dir), _part_feeds(spark, sf_dir), M.companies(spark, sf_dir), runtime
    )
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))

    def line(f):
        return F.concat_ws(
            "|", f["feed_id"].cast("string"), f["feed_url"], dash(f["company_id"]), dash(f["host_header"]),
            f["fetchprotection"].cast("string"), dash(f["etag"]), dash(stamp(f["last_update"])),
            dash(stamp(f["last_db_article_published_at"])),
        )

    return payloads.select(
        "task_id",
        "payload.job_id",
        stamp("payload.requested_at").alias("requested_at"),
        "payload.ingest",
        "payload.requested_by",
        F.array_join(F.transform("payload.feeds", line), " ; ").alias("feeds"),
    )


@query(
    "stale_tasks",
    f"""WITH {_REFS} SELECT task_id, concat('job', o_custkey) AS job_id,
            CASE WHEN wanted = 0 THEN 'no_refs' ELSE 'feed_missing' END AS reason, CAST(wanted - found AS BIGINT) AS missing_feeds
        FROM tasks WHERE wanted = 0 OR wanted > found""",
)
def stale_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.stale_tasks(_order_parts(spark, sf_dir), _part_feeds(spark, sf_dir))


def _typed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claimed tasks of three types, one of which does not fetch."""
    kind = F.when(F.col("task_id") % 5 == 0, "embed.source").when(F.col("task_id") % 5 == 1, "rss.fetch.retry")
    return _order_parts(spark, sf_dir).select(
        "*",
        kind.otherwise("rss.fetch").alias("task_type"),
        F.concat(F.lit("e"), "task_id").alias("execution_id"),
        F.lit("processing").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("claim_expires_at"),
        F.coalesce(F.size(clean_ref_ids(F.col("ref_ids"))), F.lit(0)).alias("item_total"),
        F.col("task_id").alias("claim_seq"),
    )


_STALE_FETCH = "task_id % 5 <> 0 AND (wanted = 0 OR wanted > found)"


@query(
    "stale_outcomes",
    f"""WITH {_REFS} SELECT task_id, 'accepted' AS verdict, 'failed' AS status, CAST(0 AS BIGINT) AS item_success, CAST(wanted AS BIGINT) AS item_error,
            concat('stale_reference: ', CASE WHEN wanted = 0 THEN 'no_refs' ELSE 'feed_missing' END) AS last_error
        FROM tasks WHERE {_STALE_FETCH}
        UNION ALL SELECT task_id, 'unsupported_type', NULL, NULL, NULL, NULL FROM tasks WHERE task_id % 5 = 0""",
)
def stale_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _typed_tasks(spark, sf_dir)
    stale = cut_lineage(O.stale_tasks(tasks, _part_feeds(spark, sf_dir)))
    reports = O.stale_outcomes(stale, tasks, "claim_seq", F.lit("1998-06-01").cast("timestamp_ntz"))
    columns = ["task_id", "verdict", "status", "item_success", "item_error", "last_error"]
    judged = task_outcomes(reports, tasks).select(columns)
    other = stale.where(F.col("reason") == "unsupported_type").select("task_id", F.col("reason").alias("verdict"))
    return judged.unionByName(other, allowMissingColumns=True)


@query(
    "stale_counters",
    f"""WITH {_REFS} SELECT name AS counter_name, CASE WHEN name LIKE 'payload%' THEN (SELECT count(*) FROM tasks WHERE {_STALE_FETCH}) ELSE 0 END AS counter_value
        FROM (VALUES ('stale_redis_task_ids_dropped'), ('embedding_tasks_requeued'), ('payload_rebuild_failures')) v(name)""",
)
def stale_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = O.stale_tasks(_typed_tasks(spark, sf_dir), _part_feeds(spark, sf_dir))
    return runtime_counters(O.rebuild_failures(stale))


@query(
    "completeness_violations",
    """WITH refs AS (SELECT DISTINCT l_orderkey AS task_id, l_partkey AS feed_id FROM lineitem WHERE l_partkey > 0),
        seen AS (
            SELECT CASE WHEN (feed_id + task_id) % 7 = 0 THEN -1 ELSE task_id END AS task_id,
                CASE WHEN (feed_id + task_id) % 11 = 0 THEN feed_id + 1000000 ELSE feed_id END AS feed_id,
                unnest(range(CASE WHEN (feed_id + task_id) % 13 = 0 THEN 2 ELSE 1 END)) AS copy, feed_id % 17 = 0 AS wrong
            FROM refs),
        n AS (SELECT task_id, feed_id, count(*) AS n FROM seen WHERE task_id >= 0 GROUP BY ALL)
        SELECT task_id, feed_id, 'missing' AS rule, 0 AS n FROM refs ANTI JOIN n USING (task_id, feed_id)
        UNION ALL SELECT task_id, feed_id, 'unexpected', n FROM n ANTI JOIN refs USING (task_id, feed_id)
        UNION ALL SELECT task_id, feed_id, 'duplicate', n FROM n WHERE n > 1
        UNION ALL SELECT task_id, NULL, 'wrong_job', count(*) FROM seen WHERE wrong AND task_id >= 0 GROUP BY task_id
        UNION ALL SELECT o_orderkey, NULL, 'no_refs', 0 FROM orders WHERE o_orderkey NOT IN (SELECT task_id FROM refs)""",
)
def completeness_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _order_parts(spark, sf_dir)
    both = F.col("feed_id") + F.col("task_id")
    asked = tasks.select("task_id", "job_id", F.explode("ref_ids").alias("feed_id")).where(F.col("feed_id") > 0)
    seen = asked.select(
        # Events of a task that does not exist leave their feed missing.
        F.when(both % 7 == 0, -1).otherwise(F.col("task_id")).alias("task_id"),
        F.when(both % 11 == 0, F.col("feed_id") + 1000000).otherwise(F.col("feed_id")).alias("feed_id"),
        F.when(F.col("feed_id") % 17 == 0, "other").otherwise(F.col("job_id")).alias("job_id"),
        F.explode(F.sequence(F.lit(1), F.when(both % 13 == 0, 2).otherwise(1))).alias("copy"),
    )
    return Q.completeness_violations(tasks, seen)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result events as JSON envelopes of five events each; some texts are cut off."""
    events = M.result_events(spark, sf_dir)
    event = F.struct("feed_id", "job_id", "status", "status_code", "sources", "new_etag", "new_last_update")
    # Five events per envelope at most.
    grouped = events.groupBy(F.floor(F.col("event_seq") / 5).alias("envelope_id")).agg(
        F.sort_array(F.collect_list(F.struct("event_seq", event.alias("e")))).alias("es")
    )
    body = F.to_json(F.struct(F.lit("1.0").alias("contract_version"), F.transform("es", lambda x: x["e"]).alias("result_events")))
    cut = F.when(F.col("envelope_id") % 9 == 0, F.left(body, F.length(body) - 1)).otherwise(body)
    return grouped.select("envelope_id", cut.alias("body"))


@query(
    "result_events_parse",
    """SELECT doc_id // 5 AS envelope_id, (doc_id // 5) % 9 = 0 AS parse_error,
            CASE WHEN (doc_id // 5) % 9 = 0 THEN 0 ELSE count(*) END AS events,
            CAST(CASE WHEN (doc_id // 5) % 9 = 0 THEN 0 ELSE sum(1 + (doc_id % 4 = 0)::INT + (doc_id % 6 = 0)::INT) END AS BIGINT) AS sources,
            CASE WHEN (doc_id // 5) % 9 <> 0 THEN md5(string_agg(coalesce(CASE WHEN doc_id % 13 <> 0 THEN text END, '-'), '' ORDER BY doc_id)) END AS summaries
        FROM documents GROUP BY doc_id // 5""",
)
def result_events_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_results(envelopes(spark, sf_dir))
    summaries = F.transform("result_events", lambda e: F.coalesce(e["sources"][0]["summary"], F.lit("-")))
    sources = F.aggregate("result_events", F.lit(0).cast("bigint"), lambda n, e: n + F.size(e["sources"]))
    return parsed.select(
        "envelope_id",
        "parse_error",
        F.size("result_events").cast("bigint").alias("events"),
        sources.alias("sources"),
        F.when(~F.col("parse_error"), F.md5(F.array_join(summaries, ""))).alias("summaries"),
    )


@query(
    "result_counts",
    """SELECT doc_id // 5 AS envelope_id, count(*) FILTER (doc_id % 9 <> 0) AS item_success, count(*) FILTER (doc_id % 9 = 0) AS item_error
        FROM documents GROUP BY 1""",
)
def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = M.result_events(spark, sf_dir).select(F.floor(F.col("event_seq") / 5).alias("envelope_id"), F.struct("status").alias("e"))
    # Five events per envelope at most.
    sets = events.groupBy("envelope_id").agg(F.collect_list("e").alias("events"))
    return sets.select("envelope_id", result_counts_of(F.col("events")).alias("c")).select("envelope_id", "c.*")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one-event envelopes that break one rule each by remainder."""
    n = F.col("doc_id") % 24
    hit = lambda i, bad, good: F.when(n == i, bad).otherwise(good)
    text = lambda c, size: F.repeat(F.lit(c), size)
    none = F.lit(None)
    source = F.struct(
        hit(5, F.lit(""), hit(6, text("é", 2001), hit(7, none, text("é", 2000)))).alias("title"),
        hit(8, text("s", 20001), F.col("text")).alias("summary"),
        hit(9, F.array().cast("array<string>"), hit(10, F.array_repeat(F.lit("u"), 65), hit(11, F.array(F.lit("u"), F.lit("")), hit(12, F.array(text("u", 4001)), F.array(text("u", 4000)))))).alias("urls"),
        none.cast("timestamp").alias("published_at"),
        hit(13, text("a", 256), text("a", 255)).alias("author"),
        hit(14, F.array(F.lit("A"), none), F.array(F.lit("A"))).alias("authors"),
        hit(15, text("i", 4001), none).alias("image_url"),
    )
    good = F.struct(*[hit(-1, none, source[c]).alias(c) for c in ["title", "summary", "urls", "published_at", "author", "authors", "image_url"]])
    event = F.struct(
        hit(0, F.lit(0), F.col("doc_id") + 1).alias("feed_id"),
        hit(1, F.lit(""), text("j", 128)).alias("job_id"),
        hit(2, F.lit("done"), F.lit("not_modified")).alias("status"),
        hit(3, F.lit(99), hit(4, F.lit(600), F.lit(599))).alias("status_code"),
        hit(16, text("e", 1025), text("e", 1024)).alias("new_etag"),
        none.cast("timestamp").alias("new_last_update"),
        F.array(good).alias("sources"),
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("envelope_id"),
        hit(17, F.lit(""), hit(18, text("v", 81), F.lit("1"))).alias("contract_version"),
        F.array(event).alias("result_events"),
        (n == 19).alias("parse_error"),
    )


_RULES = """
    (VALUES (0, 'feed_id', 0, NULL), (1, 'job_id', 0, NULL), (2, 'status', 0, NULL), (3, 'status_code', 0, NULL), (4, 'status_code', 0, NULL),
        (5, 'title', 0, 0), (6, 'title', 0, 0), (7, 'title', 0, 0), (9, 'urls', 0, 0), (10, 'urls', 0, 0), (11, 'url', 0, 0), (12, 'url', 0, 0),
        (13, 'author', 0, 0), (14, 'authors', 0, 0), (15, 'image_url', 0, 0), (16, 'new_etag', 0, NULL),
        (17, 'contract_version', NULL, NULL), (18, 'contract_version', NULL, NULL), (19, 'parse', NULL, NULL)) rules(n, rule, event_pos, source_pos)
"""
_BROKEN = f"""
    SELECT doc_id AS envelope_id, rule, event_pos, source_pos FROM documents JOIN {_RULES} ON n = doc_id % 24
    UNION ALL SELECT doc_id, 'summary', 0, 0 FROM documents WHERE doc_id % 24 = 8 OR length(text) > 20000
"""


@query("contract_violations", _BROKEN)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.contract_violations(_judged(spark, sf_dir))


@query(
    "contract_split",
    f"""WITH broken AS ({_BROKEN}) SELECT doc_id AS envelope_id, doc_id NOT IN (SELECT envelope_id FROM broken) AS accepted FROM documents""",
)
def contract_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = Q.split_valid(_judged(spark, sf_dir))
    return good.select("envelope_id", F.lit(True).alias("accepted")).unionByName(
        bad.select("envelope_id", F.lit(False).alias("accepted"))
    )


_BODY = (
    '{"contract_version": "1", "result_events": [{"feed_id": %s, "job_id": "j", "status": "success", "status_code": 200, "new_etag": null, '
    '"sources": [{"title": "%s", "summary": null, "urls": ["u"], "authors": ["A"]}]}]}'
)
#: By remainder: what is replaced in the body, by what, and the rules this breaks with event and source.
_TYPE_CASES = [
    ('"contract_version": "1"', '"contract_version": 1', [("contract_version", None, None)]),
    ('"feed_id": ', '"feed_id": true, "was": ', [("feed_id", 0, None)]),
    ('"job_id": "j"', '"job_id": 7', [("job_id", 0, None)]),
    ('"status_code": 200', '"status_code": "many"', [("status_code", 0, None)]),
    ('"new_etag": null', '"new_etag": 5', [("new_etag", 0, None)]),
    ('"title": "', '"title": 12, "was": "', [("title", 0, 0)]),
    ('"urls": ["u"]', '"urls": ["u", 3]', [("url", 0, 0)]),
    ('"urls": ["u"]', '"urls": null', [("url", 0, 0), ("urls", 0, 0)]),
    ('"authors": ["A"]', '"authors": [null]', [("authors", 0, 0)]),
    ('"summary": null', '"summary": false', [("summary", 0, 0)]),
    ('"status_code": 200', '"status_code": "200.0"', []),
    ('"authors": ["A"]', '"authors": []', []),
    ('"status": "success"', '"status": "done"', [("status", 0, None)]),
    ('"summary": null, ', "", []),
]


def _type_rules() -> str:
    show = lambda x: "NULL" if x is None else str(x)
    rows = [f"({n}, '{rule}', {show(e)}, {show(p)})" for n, (_, _, rules) in enumerate(_TYPE_CASES) for rule, e, p in rules]
    return f"SELECT doc_id AS envelope_id, rule, event_pos, source_pos FROM documents JOIN (VALUES {', '.join(rows)}) r(n, rule, event_pos, source_pos) ON n = doc_id % {len(_TYPE_CASES)}"


@query("contract_bodies", _type_rules())
def contract_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON bodies with a value of a wrong type each, by remainder."""
    n = F.col("doc_id") % len(_TYPE_CASES)
    body = F.format_string(_BODY, (F.col("doc_id") + 1).cast("string"), F.md5("text"))
    cases = F.array(*[F.struct(F.lit(old).alias("old"), F.lit(new).alias("new")) for old, new, _ in _TYPE_CASES])
    case = F.element_at(cases, (n + 1).cast("int"))
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("envelope_id"), F.replace(body, case["old"], case["new"]).alias("body"))
    return Q.contract_violations(parse_results(raw))
