"""Analytics for evidence review and for training-data corpora, on Spark DataFrames."""
