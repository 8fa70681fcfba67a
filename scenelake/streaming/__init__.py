"""Structured Streaming forms of the append and update paths."""
