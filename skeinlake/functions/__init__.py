"""Column functions and lookup tables."""
