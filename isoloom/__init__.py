"""isoloom: splicing and interval analytics on Spark DataFrames."""
