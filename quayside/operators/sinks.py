"""Sinks: partitioned files, CSV and delimited text, each with a reader in `sources` that gives the same rows back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.text import delimited_line
from quayside.sources.delimited import NULL_TEXT

# What a field of one line cannot hold, because files are split at line breaks for reading.
LINE_BREAK = "[\n\r]"


def write_partitioned(df: DataFrame, path: str, partition: Sequence[str], *, mode: str = "errorifexists") -> None:
    """Write Parquet files in a folder for each value of `partition`.

    Rows of a partition are brought together first, so that its files do not multiply with the tasks
    that had rows of it; a partition that is too large for one task is split again.
    """
    df.hint("rebalance", *partition).write.partitionBy(*partition).mode(mode).parquet(path)


def _refusing(column: Column, wrong: Column, message: str) -> Column:
    return F.when(wrong, F.raise_error(F.concat(F.lit(f"{message}: "), column))).otherwise(column)


def write_csv(df: DataFrame, path: str, *, null_text: str = NULL_TEXT) -> None:
    """Write headered CSV, one file per task; `scan_csv` with the same `null_text` gives the rows back as text.

    Fields are quoted where needed, quotes are doubled, spaces at the ends are kept, NULL is `null_text` and an
    empty text `""`. A field with a line break, or one that reads like NULL, makes the write fail.
    """
    texts = []
    for name in df.columns:
        text = F.col(f"`{name}`").cast("string")
        text = _refusing(text, text.rlike(LINE_BREAK), "a field has a line break")
        texts.append(_refusing(text, text == null_text, "a field reads like NULL").alias(name))
    options = {"header": True, "escape": '"', "nullValue": null_text, "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(*texts).write.options(**options).csv(path)


def write_delimited(df: DataFrame, path: str, *, separator: str = ",") -> None:
    """Write headered files of delimited text without quotes, one per task, as `scan_delimited` reads them.

    NULL is `\\N`. A field with the separator or a line break, which such a file cannot hold, makes
    the write fail, and so does a row that would be an empty line.
    """
    fields = []
    for name in df.columns:
        text = F.col(f"`{name}`").cast("string")
        text = _refusing(text, text.contains(separator) | text.rlike(LINE_BREAK), "a field cannot be delimited")
        fields.append(text)
    line = delimited_line(fields, separator, NULL_TEXT)
    line = F.when(line == "", F.raise_error(F.lit("a row would be an empty line"))).otherwise(line)
    # A single column whose separator and quote occur nowhere: the writer adds the header to each file and changes nothing.
    options = {"header": True, "sep": "\u0001", "quote": "", "escape": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(line.alias(separator.join(df.columns))).write.options(**options).csv(path)


def write_lines(df: DataFrame, path: str, *, separator: str = "\t") -> None:
    """Write the columns as text lines, one file per task, without a shuffle; NULL is `\\N`."""
    df.select(delimited_line([F.col(f"`{c}`").cast("string") for c in df.columns], separator, NULL_TEXT).alias("value")).write.text(path)
