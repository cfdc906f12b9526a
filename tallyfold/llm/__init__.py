"""Operators for large training corpora: search, filtering, dedup, tokens, packing.

Nothing else in the library imports this subpackage.
"""
