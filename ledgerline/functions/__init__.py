"""Column functions and small run-time helpers."""
