"""Registered queries: each pairs a Spark plan with the SQL that checks it."""

from feedloom.plans import articles, backfill, feeds, gate, jobs, stores, streams, web, workers  # noqa: F401
from feedloom.plans.registry import ORACLES, QUERIES  # noqa: F401
