"""Operators: pure functions from DataFrames to a DataFrame, with column names and cutoffs as arguments."""
