"""Retail inventory rescue on Spark: stock positions, shortfalls and recovery moves."""
