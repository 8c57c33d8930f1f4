"""Structured Streaming versions of the journal operators."""
