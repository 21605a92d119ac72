"""Detection data at scale, written as plain PySpark."""
