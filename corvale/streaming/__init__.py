"""Structured Streaming: task state and incremental ingest."""
