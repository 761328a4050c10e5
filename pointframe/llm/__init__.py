"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
