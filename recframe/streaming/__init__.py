"""Structured Streaming forms of the ingestion, attribution and windowed
metric operators.  ``ops`` holds transformations that run unchanged on batch
and streaming DataFrames (so the batch replay is the oracle); ``jobs`` wires
sources, watermarks, triggers and sinks."""
