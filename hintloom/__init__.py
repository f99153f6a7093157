"""Spark-first engine for building, retrieving and evaluating libraries of reasoning hints."""

__version__ = "0.1.0"
