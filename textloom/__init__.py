"""Text analytics on Spark: every capability is a function from DataFrame to DataFrame."""
