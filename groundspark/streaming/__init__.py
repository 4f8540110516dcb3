"""Structured Streaming forms of the online jobs."""
