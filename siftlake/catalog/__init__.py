"""Registered queries: each runs an operator over the given tables, with SQL to compare with where it exists."""
