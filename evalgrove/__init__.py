"""Evaluation analytics for retrieval and routing systems, on Spark DataFrames."""
