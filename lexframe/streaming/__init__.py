"""Incremental ingest with Structured Streaming (STR1)."""
