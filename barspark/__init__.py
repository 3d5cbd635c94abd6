"""Point-in-time analytics over time-series bars, written as Spark DataFrame operations."""
