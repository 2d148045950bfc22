"""Operators over DataFrames: search and data changes."""
