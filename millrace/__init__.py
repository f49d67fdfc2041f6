"""User-level data jobs on Spark: DataFrames and parameters in, DataFrames or written datasets out."""
