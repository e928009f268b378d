"""Post-processing of search and retrieval results as Spark DataFrames."""
