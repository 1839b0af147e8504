"""Sequence-assembly analytics on Spark: pure functions from DataFrames to DataFrames."""
