"""Telemetry analytics on Spark: ingestion, typed tables and usage reports."""
