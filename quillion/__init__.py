"""quillion: full-text retrieval as ordinary Spark DataFrames."""
