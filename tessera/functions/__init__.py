"""Column expressions: geometry, tiles, labels."""
