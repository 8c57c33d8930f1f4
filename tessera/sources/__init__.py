"""Readers, scan rules and writers."""
