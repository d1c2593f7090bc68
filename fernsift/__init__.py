"""Source-code findings as Spark DataFrames."""
