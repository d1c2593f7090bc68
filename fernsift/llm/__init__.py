"""Operators for training-data corpora: output of token ids, scans, filters, near-duplicates, mixing.

Nothing else in the library imports this package.
"""
