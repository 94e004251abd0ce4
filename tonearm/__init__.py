"""Content-based recommendation analytics on Spark DataFrames."""
