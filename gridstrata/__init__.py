"""Gridded climate ensemble analytics on Spark DataFrames."""
