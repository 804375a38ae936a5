"""Retrieval over recorded conversations, as Spark plans over Parquet tables."""
