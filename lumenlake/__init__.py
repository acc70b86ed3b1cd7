"""Photo-library analytics and training-data operators as Spark DataFrames."""
