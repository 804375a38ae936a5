"""Ingest and expiry as Structured Streaming queries."""
