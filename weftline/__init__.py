"""Weftline: distributed data movement and bounded pipelines on Spark DataFrames."""
