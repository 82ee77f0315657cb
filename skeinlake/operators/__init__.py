"""Operators over DataFrames: extraction, diffs, graphs, impact, rules, trends, operations."""
