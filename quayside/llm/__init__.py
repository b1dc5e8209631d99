"""Operators for preparing training data for language models.

Nothing outside this subpackage imports it. Each module holds one operator; `queries` binds them
to the given tables.
"""
