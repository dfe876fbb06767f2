"""Registered queries: memory operators bound to the tables of a data directory, with SQL to check them."""
