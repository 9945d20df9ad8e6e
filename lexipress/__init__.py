"""lexipress: prompt and corpus compression analytics on Spark DataFrames."""
