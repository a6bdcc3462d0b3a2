"""Column functions: everything here is a plain Spark expression."""
