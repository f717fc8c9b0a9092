"""Typed N-dimensional chunked arrays as Spark DataFrames."""
