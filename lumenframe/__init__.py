"""lumenframe: light-curve analytics on Spark DataFrames."""
