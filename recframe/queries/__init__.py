"""Registered queries: Spark callables and their DuckDB oracle texts."""
