"""Operators on training text: near duplicates, overlaps, splitting, tokens, leaks and encoding repair."""
