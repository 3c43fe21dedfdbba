"""Whole passes over listings, and the queries that show each operator on the benchmark tables."""
