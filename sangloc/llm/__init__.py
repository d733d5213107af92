"""Operators of a training-data pipeline: deduplication, filtering, archives and tokens."""
