"""Incremental jobs on Structured Streaming."""
