"""A change-data-capture engine on Spark SQL and Structured Streaming."""
