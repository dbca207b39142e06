"""Incremental (Structured Streaming) forms of the resumable operators."""
