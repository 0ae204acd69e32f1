"""Relational operators on Spark DataFrames that the SQL front-end doesn't reach, or that stand by themselves."""
