"""Airport-throughput analytics as plain Spark DataFrame transformations."""
