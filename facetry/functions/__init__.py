"""Scalar helpers: literals, units, templates, records and identifiers."""
