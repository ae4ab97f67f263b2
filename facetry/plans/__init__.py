"""Plans of the geometry engine."""
