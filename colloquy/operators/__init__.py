"""Operators: folding, filters, text and vector search, fusion, tables and their upkeep."""
