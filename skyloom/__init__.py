"""Spatiotemporal feature engine on Spark DataFrames."""
