"""Readers of change feeds: topics, envelopes, offsets."""
