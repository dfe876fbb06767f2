"""Continuous ingest, gating, deduplication, summaries and indexing of a turn log."""
