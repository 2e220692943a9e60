"""Whole jobs: ingestion, similar books, bulk edges, learning from feedback."""
