"""Operators on tables: each takes DataFrames and returns a lazy DataFrame."""
