"""Column builders: plain Spark expressions without any action."""
