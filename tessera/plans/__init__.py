"""Named queries with their SQL twins."""
