"""Incremental ingestion and state machines on Structured Streaming."""
