"""Earthquake-catalogue analytics on Spark DataFrames."""
