"""Spark-native analytics for the tables behind forensic speech analysis."""

__version__ = "0.1.0"
