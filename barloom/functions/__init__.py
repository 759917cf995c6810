"""Column expressions: arithmetic guards, moving averages, indicators."""
