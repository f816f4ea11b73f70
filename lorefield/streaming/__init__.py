"""Structured Streaming: incremental ingest, request pacing and chat event frames."""
