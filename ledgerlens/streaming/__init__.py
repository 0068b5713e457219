"""Structured Streaming twins of the log reducers."""
