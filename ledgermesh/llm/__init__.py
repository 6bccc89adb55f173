"""Operators for training data: duplicates, matching, tokens."""
