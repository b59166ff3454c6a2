"""Generic operators: DataFrames and column names in, lazy DataFrames out."""
