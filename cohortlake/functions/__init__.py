"""Column expressions and fixed code sets."""
