"""inkgrid: drawing and relational analytics on Spark DataFrames."""
