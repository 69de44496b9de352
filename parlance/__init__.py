"""parlance: timed conversation analytics expressed on Spark DataFrames."""
