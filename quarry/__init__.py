"""quarry: code-corpus analytics on Spark DataFrames."""
