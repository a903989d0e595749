"""Operators over a collection's logical tables."""
