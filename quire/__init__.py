"""quire: text-library analytics on Spark DataFrames."""
