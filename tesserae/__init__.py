"""Profile search over sequence collections, written for Spark DataFrames."""
