"""Structured Streaming over log records."""
