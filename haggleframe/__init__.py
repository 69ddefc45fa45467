"""Marketplace analytics on Spark DataFrames."""
