"""Polygon-coverage analytics on Spark DataFrames."""
