"""Operators for training-data pipelines: ten operators, their queries and SQL."""
