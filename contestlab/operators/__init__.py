"""Operators over DataFrames, with columns as parameters."""
