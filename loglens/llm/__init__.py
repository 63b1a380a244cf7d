"""Operators for preparing training data: deduplication, filtering, mixing, tokenising, formatting and search."""
