"""Operators for preparing training text: dedup, classifiers, scans, mixing, sharding, tokens."""
