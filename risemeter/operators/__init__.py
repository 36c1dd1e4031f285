"""DataFrame operators: each function takes DataFrames and returns a DataFrame."""
