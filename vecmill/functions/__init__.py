"""Column expressions and the DataFrame helpers built on them."""
