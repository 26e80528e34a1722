"""Index maintenance from streams."""
