"""Operators on tables and folders: changes, checks, comparisons, rollups and statements."""
