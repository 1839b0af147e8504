"""Operators as functions of DataFrames and arguments; ``strandlake.plans`` calls them for the queries."""
