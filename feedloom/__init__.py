"""feedloom: feed-ingestion analytics as Spark DataFrame jobs."""
