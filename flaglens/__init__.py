"""Feature-toggle analytics on Spark DataFrames."""
