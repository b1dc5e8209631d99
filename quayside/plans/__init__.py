"""Queries that apply the operators to the given tables, and their SQL."""
