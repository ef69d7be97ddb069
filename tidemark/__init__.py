"""Entity-period analytics on Spark DataFrames."""
