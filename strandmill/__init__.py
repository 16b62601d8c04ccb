"""Conversational-memory retrieval, evaluation and analytics on Spark DataFrames."""
