"""Structured Streaming forms of the exact-key operators."""
