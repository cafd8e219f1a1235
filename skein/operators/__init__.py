"""Operators on DataFrames of sources."""
