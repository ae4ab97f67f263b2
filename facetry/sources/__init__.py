"""Sources of the geometry engine."""
