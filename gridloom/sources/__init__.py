"""Readers, writers and the Parquet test tables."""
