"""Relational operators over facets: predicates, distances, nearest neighbours, windows, statistics."""
