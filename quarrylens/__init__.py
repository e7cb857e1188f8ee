"""Code-intelligence and corpus analytics on Spark DataFrames."""
