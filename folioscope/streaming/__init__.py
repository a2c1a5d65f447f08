"""Structured Streaming jobs: job queue, progress and incremental ingest."""
