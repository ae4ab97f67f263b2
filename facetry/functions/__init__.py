"""Functions of the geometry engine."""
