"""Column functions: geometry, classes, text."""
