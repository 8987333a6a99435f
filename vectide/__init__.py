"""Exact, sharded vector search and its data operations on Spark DataFrames."""
