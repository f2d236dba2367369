"""tidemark: time-series and multi-asset analytics as plain Spark DataFrame operations."""
