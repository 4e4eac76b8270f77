"""Incremental ingestion of export files with Structured Streaming (no streaming-only operators)."""
