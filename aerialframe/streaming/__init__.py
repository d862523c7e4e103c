"""Incremental ingest of photo folders."""
