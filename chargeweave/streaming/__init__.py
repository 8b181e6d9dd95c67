"""Structured Streaming variants of the stateless request scoring."""
