"""Structured Streaming forms of ingest and counting."""
