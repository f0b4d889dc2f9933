"""Set-at-a-time operators: every function maps DataFrames to a DataFrame."""
