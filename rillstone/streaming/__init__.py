"""Structured Streaming capture of change feeds."""
