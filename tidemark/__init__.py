"""Tidemark: change tracking, ranked retrieval and evaluation over tables, on Spark."""

__version__ = "0.1.0"
