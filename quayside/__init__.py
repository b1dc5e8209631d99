"""Batch data-movement operators for Spark: land, load, check, compare and roll up tables.

Each operator takes DataFrames (or a session and a location) and returns a DataFrame; only the
sinks and the table commands write. Nothing is collected beyond single values and metadata.
"""

__version__ = "0.1.0"
