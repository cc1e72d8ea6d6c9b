"""Operators that prepare training text: search, dedup, filters, tokens, shards, packing."""
