"""Readers of the extracts, snapshots between stages, and the CSV sink."""
