"""Parsing and resolving one JavaScript text: plain Python, no Spark."""
