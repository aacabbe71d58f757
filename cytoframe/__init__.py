"""Cell-signal analytics as Spark DataFrame operations."""
