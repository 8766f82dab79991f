"""Document analytics, retrieval and governance on Spark DataFrames."""
