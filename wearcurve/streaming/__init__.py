"""Controllers over streams."""
