"""Data-understanding operators on Spark DataFrames."""
