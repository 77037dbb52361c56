"""Spark-native record-format engine: scientific files as DataFrames."""

__version__ = "0.1.0"
