"""Whole pipelines made of operators."""
