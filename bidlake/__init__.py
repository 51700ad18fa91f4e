"""Spark-first analytics over public-procurement acquisition data."""
