"""Whole queries: the engine's entry points, the printed form of results, and the catalogue of registered queries."""
