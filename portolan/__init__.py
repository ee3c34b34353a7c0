"""Spark-native trade-exposure analytics: sources, functions, operators, plans and streams."""

__version__ = "0.1.0"
