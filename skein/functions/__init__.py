"""Predicates and rewrites of texts, for columns and for single values."""
