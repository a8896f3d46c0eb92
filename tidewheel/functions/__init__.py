"""Column expressions with IEEE semantics over nullable doubles."""
