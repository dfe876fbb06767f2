"""Relational operators over memory tables. Each takes and returns DataFrames."""
