"""Column-level helpers. Everything here returns Spark Columns; nothing runs a job."""
