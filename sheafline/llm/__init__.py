"""Operators for training corpora: sharding, near-duplicates, filters, packing, tokens, pseudonyms.

Nothing else in the library imports this subpackage.
"""
