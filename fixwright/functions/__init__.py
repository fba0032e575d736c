"""Column expressions and grouped statistics shared by the operators."""
