"""folioloom: document retrieval and evaluation analytics on Spark DataFrames."""
