"""Explicit schemas of incoming and stored tables; nothing is inferred."""

from __future__ import annotations

SOURCE = (
    "STRUCT<title: STRING, summary: STRING, urls: ARRAY<STRING>, published_at: TIMESTAMP, "
    "author: STRING, authors: ARRAY<STRING>, image_url: STRING>"
)
EVENT = (
    "STRUCT<feed_id: BIGINT, job_id: STRING, status: STRING, status_code: INT, new_etag: STRING, "
    f"new_last_update: TIMESTAMP, sources: ARRAY<{SOURCE}>>"
)
ENVELOPE = (
    f"contract_version STRING, result_events ARRAY<{EVENT}>, "
    "local_dedup STRUCT<article_keys: ARRAY<STRING>, content_keys: ARRAY<STRING>>"
)
#: An envelope as it is read: numbers are text until they are known to be whole.
RAW_ENVELOPE = ENVELOPE.replace("feed_id: BIGINT", "feed_id: STRING").replace("status_code: INT", "status_code: STRING")
ARTICLES = (
    "article_key STRING, content_key STRING, published_at TIMESTAMP, ingested_at TIMESTAMP, "
    "canonical_url STRING, title STRING, summary STRING, image_url STRING, country STRING, "
    "language STRING, company_id BIGINT"
)
FEED_RUNTIME = (
    "feed_id BIGINT, last_scraped_at TIMESTAMP, last_status STRING, etag STRING, last_feed_update TIMESTAMP, "
    "last_article_published_at TIMESTAMP, consecutive_error_count BIGINT, last_error_at TIMESTAMP, "
    "last_error_code INT"
)
