"""Column expressions and vectorised numerics."""
