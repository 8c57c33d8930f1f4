"""Operators for training-data corpora, and their queries."""
