"""The SQL dialect: text to syntax, syntax to Spark SQL."""
