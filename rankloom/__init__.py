"""Click-log retrieval, ranking and evaluation on Spark DataFrames."""
