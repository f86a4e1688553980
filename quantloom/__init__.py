"""Portfolio and text-corpus analytics on Spark DataFrames."""
