"""Structured Streaming pipelines: incremental ingestion and event windows."""
