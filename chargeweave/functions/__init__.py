"""Column expressions; every function returns a built-in Spark expression."""
