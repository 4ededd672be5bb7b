"""Identity keys of articles and task references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import identity_text, let

SEPARATOR = "\x1f"


def iso_utc(ts: Column) -> Column:
    """Timestamp as ISO text; the session zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(part, F.lit("")) for part in parts]), 256)


def article_key(url: Column, title: Column, authors: Column, company: Column, published_at: Column) -> Column:
    """Digest of everything that identifies one publication of an article."""
    names = F.array_join(F.transform(authors, identity_text), ",")
    return _digest(url, identity_text(title), names, identity_text(company), iso_utc(published_at))


def content_key(title: Column, summary: Column, company: Column, published_at: Column) -> Column:
    """Digest of the content; null when title or summary carries no text."""
    texts = F.array(identity_text(title), identity_text(summary))
    rest = (identity_text(company), iso_utc(published_at))
    return let(texts, lambda t: F.when(F.forall(t, lambda x: x.isNotNull()), _digest(t[0], t[1], *rest)))


# Reference namespaces and the prefix of supported task types.
FETCH_TASK_PREFIX = "rss.fetch"
FETCH_NAMESPACE = "rss"
OTHER_NAMESPACE = "unknown"


def is_fetch_task(task_type: Column) -> Column:
    return task_type.startswith(FETCH_TASK_PREFIX)


def payload_ref(task_type: Column, task_id: Column, execution_id: Column) -> Column:
    namespace = F.when(is_fetch_task(task_type), F.lit(FETCH_NAMESPACE)).otherwise(F.lit(OTHER_NAMESPACE))
    return F.concat_ws(":", namespace, task_id.cast("string"), execution_id.cast("string"))


def parse_payload_ref(ref: Column) -> Column:
    """``(task_id, execution_id, valid)``; a reference needs three parts, the last two whole numbers."""
    parts = F.split(ref, ":")
    number = lambda i: F.when(F.size(parts) == 3, F.trim(F.get(parts, i)).try_cast("bigint"))
    whole = lambda i: F.coalesce(F.get(parts, i).rlike(r"^\s*[+-]?[0-9]+\s*$"), F.lit(False))
    valid = (F.size(parts) == 3) & whole(1) & whole(2)
    return F.struct(
        F.when(valid, number(1)).alias("task_id"), F.when(valid, number(2)).alias("execution_id"), valid.alias("valid")
    )


def clean_ref_ids(ids: Column) -> Column:
    """Positive whole numbers of an id array, in order."""
    return F.filter(F.transform(ids, lambda x: x.try_cast("bigint")), lambda x: x > 0)
