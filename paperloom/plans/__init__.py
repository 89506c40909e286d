"""Whole queries: ingestion, the read API, extensions."""
