"""Column-expression helpers shared by the operators (all built-in Spark functions)."""
