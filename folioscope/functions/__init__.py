"""Column functions and request parameters."""
