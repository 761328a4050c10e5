"""Point-cloud analytics on Spark DataFrames."""
