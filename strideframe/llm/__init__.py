"""Operators for large training-data corpora, each one a set of Spark jobs."""
