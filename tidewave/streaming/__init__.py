"""Mergeable summaries for Structured Streaming."""
