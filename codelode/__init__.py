"""codelode: code-intelligence analytics on Spark DataFrames."""
