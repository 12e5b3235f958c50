"""Ranked full-text search and analytics over Spark DataFrames."""

__version__ = "0.1.0"
