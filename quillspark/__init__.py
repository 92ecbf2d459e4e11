"""Document and manuscript analytics on Spark DataFrames."""
