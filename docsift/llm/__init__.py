"""Operators of a training-data pipeline (nothing else in docsift imports this)."""
