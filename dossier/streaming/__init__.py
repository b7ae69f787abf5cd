"""Incremental audit with Structured Streaming."""
