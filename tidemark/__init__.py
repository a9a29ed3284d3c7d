"""Tidemark: time-series archive analytics as Spark DataFrames."""
