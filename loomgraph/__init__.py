"""Edge-centric graph analytics on Spark DataFrames."""
