"""Streaming forms of the ingest and bucket steps."""
