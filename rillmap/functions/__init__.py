"""Column functions: text, years and vectors, all built-in expressions."""
