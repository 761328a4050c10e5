"""Operators on point-cloud DataFrames."""
