"""Column expressions and text rendering."""
