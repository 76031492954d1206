"""Record linkage and training-data operators on Spark DataFrames."""
