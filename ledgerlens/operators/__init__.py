"""Domain operators: DataFrames in, DataFrames out."""
