"""Whole jobs composed of the operators, and the query registry."""
