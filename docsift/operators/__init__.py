"""Operators: each a function DataFrame(s) -> DataFrame."""
