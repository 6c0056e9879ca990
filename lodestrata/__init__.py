"""Document retrieval and evaluation as plain Spark DataFrame operations."""
