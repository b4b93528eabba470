"""Operators for large text corpora: filtering, deduplication, mixing, search and tokens.

Nothing else in the library imports this subpackage.
"""
