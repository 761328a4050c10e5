"""Streaming forms of the searches."""
