"""Structured Streaming forms of the operational aggregates."""
