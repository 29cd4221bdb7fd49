"""Click-log preparation, feature building and online logistic models on Spark DataFrames."""
