"""Operators that prepare training data: copies, packing, tokens, quality, scoring and private data."""
