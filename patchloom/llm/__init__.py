"""Operators for preparing training data: near-duplicates, archives, filters, mixing, tokens."""
