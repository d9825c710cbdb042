"""Readers, writers and the case tables derived from the given Parquet tables."""
