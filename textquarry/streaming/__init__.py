"""Structured Streaming forms of the usage queries."""
