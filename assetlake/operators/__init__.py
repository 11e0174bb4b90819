"""Relational operators of the asset catalog, as functions from DataFrames to DataFrames."""
