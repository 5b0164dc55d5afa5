"""Evidence-backed fact analytics on Spark DataFrames."""
