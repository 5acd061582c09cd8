"""Incremental ingest and windowed aggregation."""
