"""Structured Streaming ingestion and charts."""
