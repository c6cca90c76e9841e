"""Reports: chains of operators, DataFrames in and out."""
