"""Corpus analytics and retrieval on PySpark: DataFrames in, DataFrames out."""
