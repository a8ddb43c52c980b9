"""Operators that prepare text and records for training language models.

Nothing else in the library imports this subpackage.
"""
