"""A SQL and DataFrame analytics engine on Spark."""
