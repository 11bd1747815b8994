"""Functions from DataFrames and parameters to a DataFrame."""
