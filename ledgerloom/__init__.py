"""Spark-first structural analytics: projection specs, graphs, ledgers and training-data operators."""

__version__ = "0.1.0"
