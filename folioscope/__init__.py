"""Folioscope: index and search versioned text corpora with Spark DataFrames."""
