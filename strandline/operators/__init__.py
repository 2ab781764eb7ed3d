"""Relational operators: splits, similarity joins, near-duplicates, components, lexical pairs."""
