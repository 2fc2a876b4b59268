"""Typed, composable relational queries on Spark, lowered to the DataFrame API."""
