"""Posting moderation and text-quality checks as Spark DataFrame jobs."""

__version__ = "0.1.0"
