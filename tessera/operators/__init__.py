"""Operators on snapshots: match, classify, encode, apply, verify, summarise."""
