"""Column expressions and small projections; built-in functions only."""
