"""Company-evidence analytics on Spark DataFrames."""
