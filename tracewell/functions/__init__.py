"""Column expressions and text rules."""
