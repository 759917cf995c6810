"""Incremental ingest of bar files with Structured Streaming."""
