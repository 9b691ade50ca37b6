"""Column builders: plain Spark expressions, no Python code per row."""
