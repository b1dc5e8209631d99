"""Line, word and byte counts of a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII white space that separates words.
WHITE_SPACE = r"[ \t\n\x0B\f\r]+"


def line_count(text: Column) -> Column:
    """Number of newline characters."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space."""
    return F.when(text.isNotNull(), F.size(F.array_remove(F.split(text, WHITE_SPACE), ""))).cast("bigint")


def byte_count(text: Column) -> Column:
    """Length in bytes of the UTF-8 form."""
    return F.octet_length(text).cast("bigint")


def line_byte_count(line: Column) -> Column:
    """Bytes of a line read without its newline, which counts. A carriage return before it is part
    of the line; a last line without a newline counts one byte more than the file has."""
    return (F.octet_length(line) + 1).cast("bigint")


def delimited_line(fields: Sequence[Column], separator: str, null_text: str) -> Column:
    """Text fields in one line; NULL as `null_text`, so that no field moves into the place of another."""
    return F.concat_ws(separator, *[F.coalesce(field, F.lit(null_text)) for field in fields])
