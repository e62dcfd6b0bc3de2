"""Pairs-trading analytics on Spark DataFrames."""
