"""barloom: market-scan analytics as Spark DataFrame operations."""
