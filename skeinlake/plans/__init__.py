"""Composed plans and the generic query representation."""
