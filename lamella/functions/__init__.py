"""Column functions over polygons and numbers."""
