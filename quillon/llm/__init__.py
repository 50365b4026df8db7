"""Operators for large training-data pipelines: mixing, search, encoding, filtering and deduplication."""
