"""Spark-native preparation and analysis of sparse data held as DataFrames of non-zeros."""

__version__ = "0.1.0"
