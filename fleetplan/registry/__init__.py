"""Checked queries: fleet relations over the given tables, queries and their SQL."""
