"""Event search, faceting and ingestion on Spark."""
