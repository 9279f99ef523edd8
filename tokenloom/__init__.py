"""tokenloom: multi-vector retrieval analytics on Spark DataFrames."""
