"""Spark-first panel analytics: DataFrame-to-DataFrame operators over (key, date) tables."""

__version__ = "0.1.0"
