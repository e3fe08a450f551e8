"""Scans, sinks and the table stores built on Parquet and JSON."""
