"""Relational operators over DataFrames; each only builds a plan."""
