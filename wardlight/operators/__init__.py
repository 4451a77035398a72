"""Operators: DataFrames in, a DataFrame out, nothing collected."""
