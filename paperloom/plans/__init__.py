"""Whole pipelines: ingestion and translation, and the engines and backends that they call."""
