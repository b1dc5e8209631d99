"""Text files as lines, and lines as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, in the column `value`, without its newline."""
    return spark.read.text(path)


def split_columns(lines: DataFrame, columns: Sequence[str], separator: str = "\t", *, rest: str | None = None) -> DataFrame:
    """Cut `value` at every separator; missing fields are NULL.

    Surplus fields go, with their separators, into the column `rest`; without one they raise an error.
    """
    limit = len(columns) + 1
    fields = F.split("value", f"\\Q{separator}\\E", limit)
    surplus = F.get("_f", F.lit(len(columns)))
    cut = lines.select(fields.alias("_f"))
    named = [F.get("_f", F.lit(i)).alias(name) for i, name in enumerate(columns)]
    if rest is not None:
        return cut.select(*named, surplus.alias(rest))
    checked = F.when(surplus.isNotNull(), F.raise_error(F.concat(F.lit("surplus fields: "), surplus))).otherwise(F.get("_f", F.lit(0)))
    return cut.select(checked.alias(columns[0]), *named[1:])
