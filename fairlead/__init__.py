"""Fairlead: vessel position analytics on Spark DataFrames and Structured Streaming."""
