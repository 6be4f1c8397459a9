"""Column expressions and fixed values shared by the operators."""
