"""Compositions of operators: recall, ingest, summaries, reflection."""
