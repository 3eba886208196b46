"""Column functions over prose."""
