"""Last-mile delivery analytics as Spark DataFrames."""
