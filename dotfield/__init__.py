"""Point-process analytics on Spark DataFrames."""
