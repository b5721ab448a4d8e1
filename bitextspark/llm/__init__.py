"""Operators for large-scale training data: tokenising, cleaning, deduplication, formatting."""
