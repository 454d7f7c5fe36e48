"""Structured Streaming operators (live monitoring)."""
