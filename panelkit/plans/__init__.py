"""Composite pipelines and query plans."""
