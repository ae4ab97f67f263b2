"""Operators of the geometry engine."""
