"""Reading and writing indexes, and joins of source tables."""
