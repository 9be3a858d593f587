"""Sales-transaction analytics on Spark DataFrames."""
