"""Structured Streaming entry points (incremental runs of the batch operators)."""
