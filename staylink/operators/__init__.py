"""Operators: each a ``DataFrame -> DataFrame`` function with column names as parameters."""
