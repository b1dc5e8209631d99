"""Table changes: re-create, append by query, retry-safe append, replaced partitions, incremental import, partition export."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.workspace import columns_sql, quoted, text_literal, written

OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"
MARK = "quayside.mark"


def recreate_table(spark: SparkSession, table: str, like: DataFrame, *, partition: Sequence[str] = ()) -> None:
    """Drop the table if it exists and create it, empty, with the columns of `like`."""
    spark.sql(f"DROP TABLE IF EXISTS {quoted(table)}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({_fields(like)}) USING parquet{_partitioned(partition)}")


def register_table(spark: SparkSession, table: str, like: DataFrame, location: str, *, partition: Sequence[str]) -> None:
    """Put a table over partition folders that exist already, and enter them into the catalogue."""
    spark.sql(f"CREATE TABLE {quoted(table)} ({_fields(like)}) USING parquet{_partitioned(partition)} LOCATION {text_literal(location)}")
    spark.sql(f"MSCK REPAIR TABLE {quoted(table)}")


def _fields(like: DataFrame) -> str:
    return ", ".join(f"{columns_sql([f.name])} {f.dataType.simpleString()}" for f in like.schema)


def _partitioned(partition: Sequence[str]) -> str:
    return f" PARTITIONED BY ({columns_sql(partition)})" if partition else ""


def append_rows(spark: SparkSession, table: str, rows: DataFrame) -> None:
    """Append all rows, columns matched by name; duplicates and NULLs are kept."""
    spark.sql(f"INSERT INTO {quoted(table)} BY NAME SELECT {columns_sql(rows.columns)} FROM {{rows}}", rows=rows)


def unique_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rows`, failing when they run if a key is NULL or occurs twice.

    The count runs over the partitioning by key that a join on the key needs anyway, so the check
    adds no read and no shuffle to one.
    """
    null_key = F.greatest(*[F.col(f"`{k}`").isNull().cast("int") for k in keys], F.lit(0)) == 1
    times = F.count(F.lit(1)).over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]))
    first = F.col(f"`{keys[0]}`")
    checked = F.when(null_key, F.raise_error(F.lit("a key is NULL"))).when(times > 1, F.raise_error(F.lit("a key occurs twice"))).otherwise(first)
    return rows.withColumn(keys[0], checked)


def append_once(spark: SparkSession, table: str, rows: DataFrame, keys: Sequence[str], *, partition: str | None = None) -> None:
    """Append the rows whose key the table does not have, so that a retry adds nothing.

    A key that is NULL or occurs twice in `rows` raises an error before anything is added, because
    it could not be told from a retry. With `partition` (part of the key's identity) only the
    partitions of the batch are searched. For batches of whole partitions see `replace_partitions`.
    """
    there = spark.table(quoted(table))
    if partition is not None:
        there = there.join(rows.select(partition).distinct(), partition, "left_semi")
    new = unique_rows(rows, keys).join(there.select(*keys), list(keys), "left_anti")
    append_rows(spark, table, new.select(*rows.columns))


@contextmanager
def _dynamic_overwrite(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(OVERWRITE_MODE, before)


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(quoted(table)) if c.isPartition]


def replace_partitions(spark: SparkSession, table: str, rows: DataFrame, *, keys: Sequence[str] = ()) -> None:
    """Replace the partitions that `rows` has rows of by these rows, whole; all others stay.

    Doing so again leaves the table as it is, whatever a first attempt had written, and the table
    is not read. With `keys`, a key that is NULL or occurs twice in `rows` raises an error and
    leaves the table as it was. `rows` is not read from the table itself. Rows are brought together
    by partition before they are written, so a partition has few files.
    """
    partition = partition_columns(spark, table)
    if not partition:
        raise ValueError(f"{table} has no partitions")
    batch = unique_rows(rows, keys) if keys else rows
    with _dynamic_overwrite(spark):
        batch.select(*spark.table(quoted(table)).columns).hint("rebalance", *partition).write.mode("overwrite").insertInto(quoted(table))


def export_partition(spark: SparkSession, source: DataFrame, column: str, value: str, target: str) -> None:
    """Write one partition of `source` as the same partition of the table `target`, replacing what that had.

    The scan reads that partition alone. Another export of it leaves the same rows; other
    partitions of the target are not touched.
    """
    names = [c for c in spark.table(quoted(target)).columns if c != column]
    rows = source.where(F.col(f"`{column}`") == value).select(*[F.col(f"`{c}`") for c in names]).hint("rebalance")
    spark.sql(
        f"INSERT OVERWRITE TABLE {quoted(target)} PARTITION ({columns_sql([column])} = {text_literal(value)}) SELECT {columns_sql(names)} FROM {{rows}}",
        rows=rows,
    )


def stored_mark(spark: SparkSession, table: str, check: str) -> str | None:
    """The mark that the last import has left, as text."""
    found = spark.sql(f"SHOW TBLPROPERTIES {quoted(table)}").where(F.col("key") == f"{MARK}.{check}").first()
    return None if found is None else found["value"]


def _store_mark(spark: SparkSession, table: str, check: str, mark: str | None) -> None:
    if mark is not None:
        spark.sql(f"ALTER TABLE {quoted(table)} SET TBLPROPERTIES ({text_literal(f'{MARK}.{check}')} = {text_literal(mark)})")


def _above(df: DataFrame, check: str, mark: Column | None) -> DataFrame:
    return df if mark is None else df.where(F.col(f"`{check}`") >= mark)


def incremental_import(
    spark: SparkSession, source: DataFrame, table: str, check: str, keys: Sequence[str], *,
    mode: str = "append", partition: str | None = None, lookback: float | timedelta | None = None,
) -> None:
    """Import the source rows at or above the mark, the largest `check` value imported so far.

    The mark is stored with the table after each import (MARK), so the table is read only from the mark
    upwards, a filter that reaches its scan; without a stored mark it is the table's largest value,
    and an empty table imports all. A row below the mark is not imported, unless `lookback` reaches it.

    `lookback` (a number, or a time span for dates and timestamps) reads source and table from that much
    below the mark, so rows that came late into the source are found as well. The mark does not go back.

    `append` adds every row with a key and check value that the table does not have, so an updated
    row, which has a higher check value, is added as a further version and none above the mark is dropped;
    rows that tie with the mark are read again and added only if they are new. `latest` keeps for
    each key the row with the highest check value, the imported one in a tie; it replaces the
    partitions of the imported rows (all rows of a key lie in one `partition`, such as a hash of
    it), or the whole table without `partition`. Either import, run again after a
    failure at any point, gives the same table.

    A check value that is NULL raises an error, because no mark would ever find it, and so does a
    key that is NULL or that the imported rows have twice with one check value.
    """
    if mode not in ("append", "latest"):
        raise ValueError(f"unknown mode {mode}")
    if lookback is not None and lookback < type(lookback)(0):
        raise ValueError("lookback is negative")
    kind = source.schema[check].dataType
    stored = stored_mark(spark, table, check)
    if stored is None:
        stored = spark.table(quoted(table)).agg(F.max(f"`{check}`").cast("string")).first()[0]
    mark = None if stored is None else F.lit(stored).cast(kind)
    if mark is not None and lookback is not None:
        mark = (mark - F.lit(lookback)).cast(kind)
    is_null = F.col(f"`{check}`").isNull()
    fresh = source if mark is None else source.where(is_null | (F.col(f"`{check}`") >= mark))
    fresh = fresh.withColumn(check, F.when(is_null, F.raise_error(F.lit(f"{check} is NULL")).cast(kind)).otherwise(F.col(f"`{check}`")))
    there = _above(spark.table(quoted(table)), check, mark)
    identity = [*keys, check]
    if mode == "append":
        new = unique_rows(fresh, identity).join(there.select(*[F.col(f"`{c}`") for c in identity]), identity, "left_anti")
        append_rows(spark, table, new.select(*source.columns))
    else:
        _merge_latest(spark, unique_rows(fresh, identity).select(*source.columns), table, check, keys, partition)
    # Of the table, because the source may have grown in the meantime.
    _store_mark(spark, table, check, _above(spark.table(quoted(table)), check, mark).agg(F.max(f"`{check}`").cast("string")).first()[0])


def _merge_latest(spark: SparkSession, fresh: DataFrame, table: str, check: str, keys: Sequence[str], partition: str | None) -> None:
    """Write the latest row of each key of the table and `fresh`, where `fresh` has rows."""
    fresh = written(fresh, "fresh")
    current = spark.table(quoted(table))
    if partition is not None:
        # Partitions without fresh rows are pruned from the scan.
        current = current.join(fresh.select(partition).distinct(), partition, "left_semi")
    columns = spark.table(quoted(table)).columns
    both = current.select(*columns).withColumn("_fresh", F.lit(0)).unionByName(fresh.select(*columns).withColumn("_fresh", F.lit(1)))
    latest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.struct(F.col(f"`{check}`"), "_fresh"))
    merged = both.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(latest.alias("_row")).select("_row.*")
    # A table cannot be overwritten by a plan that reads it.
    staged = written(merged, "merged")
    if partition is not None:
        replace_partitions(spark, table, staged)
    else:
        staged.select(*columns).write.mode("overwrite").insertInto(quoted(table))
