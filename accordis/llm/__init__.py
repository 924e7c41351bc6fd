"""Operators for preparing training data: each is a function from DataFrames to a DataFrame."""
