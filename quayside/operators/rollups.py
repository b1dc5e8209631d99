"""Aggregations: access logs, shares, text counts, trailing measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.functions.logs import access_log_fields
from quayside.functions.text import byte_count, line_count, word_count
from quayside.sources.listing import relative, root_path


def access_log_rollup(lines: DataFrame, line: str = "value") -> DataFrame:
    """`ip, usr, request, n, bytes`: lines and bytes per visitor and request.

    Lines without a user and lines that do not match fall under NULLs; `-` bytes count as 0.
    """
    fields = access_log_fields(lines, line)
    named = F.col("usr") != "-"
    keys = [F.when(named, F.col(c)).alias(c) for c in ("ip", "usr", "request")]
    sent = F.coalesce(F.expr("try_cast(bytes as bigint)"), F.lit(0)).alias("sent")
    return fields.select(*keys, sent).groupBy("ip", "usr", "request").agg(F.count(F.lit(1)).alias("n"), F.sum("sent").alias("bytes"))


def conditional_share(df: DataFrame, keys: list[str], predicate: Column) -> DataFrame:
    """Rows, rows that meet the predicate, and their share, per group."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(predicate).alias("n_met"))
    return counted.withColumn("share", F.col("n_met") / F.col("n"))


def text_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines, words and bytes per group."""
    t = F.col(text)
    return df.groupBy(key).agg(
        F.coalesce(F.sum(line_count(t)), F.lit(0)).alias("lines"), F.coalesce(F.sum(word_count(t)), F.lit(0)).alias("words"), F.coalesce(F.sum(byte_count(t)), F.lit(0)).alias("bytes")
    )


def file_text_counts(spark: SparkSession, path: str) -> DataFrame:
    """`key, lines, words, bytes` of each file below `path`, `key` being its place there: what `wc` counts.

    Files are read as text split at line feeds alone, so carriage returns count as bytes. A file whose
    last line has no line feed holds one byte less than its lines with one each: that difference to the size that
    the storage states is taken off lines and bytes, whichever task has read the end. Spark reads no
    files without bytes, so these have no row. Words are separated by ASCII white space.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    rows = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"))
    counted = rows.groupBy("_file", "_size").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(word_count(F.col("value"))).alias("words"), F.sum(F.octet_length("value") + 1).alias("_bytes")
    )
    open_end = F.col("_bytes") - F.col("_size")
    # Spark states this path with %XX for what a URI cannot hold, and with a plain plus sign.
    key = relative(F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B"))), root_path(spark, path))
    return counted.select(key.alias("key"), (F.col("_rows") - open_end).alias("lines"), "words", F.col("_size").alias("bytes"))


def trailing_measure(df: DataFrame, key: str, day: str, days: int = 7) -> DataFrame:
    """Per key and day with rows: the rows of the day and of the `days` days that end with it.

    Daily sums come first, so the window runs over one row per key and day; it is a range of
    days, so days without rows count as such.
    """
    daily = df.groupBy(key, day).agg(F.count(F.lit(1)).alias("n"))
    trailing = Window.partitionBy(key).orderBy(F.unix_date(day)).rangeBetween(1 - days, 0)
    return daily.withColumn("n_trailing", F.sum("n").over(trailing))
