"""Transfer-network analytics on Spark DataFrames."""
