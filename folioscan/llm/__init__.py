"""Operators that prepare training data: scoring, fingerprints, tokens, joins, packing and sharding."""
