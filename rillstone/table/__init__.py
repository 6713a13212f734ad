"""Snapshot-versioned merge-on-read tables and their upkeep."""
