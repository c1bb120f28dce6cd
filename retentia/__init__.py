"""Retrieval and retention analytics over text memories, on Spark DataFrames."""
