"""Comparisons and completeness checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources.listing import qualified
from quayside.workspace import quoted

BUCKETS = 4096
# The name of a NULL partition, and of hidden files and folders.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
HIDDEN = r"(^|/)[_.]"


def _row_hash(columns: Sequence[str], seed: int) -> Column:
    """A hash of a row in which a NULL is told from a missing value of another column."""
    values = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(F.lit(seed), *values, *[v.isNull() for v in values])


def bucket_digests(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """`bucket, n, one, two`: per bucket of rows their number and the sums of two hashes of each, whatever their order."""
    wide = "decimal(38,0)"
    bucket = F.pmod(_row_hash(df.columns, 0), F.lit(buckets)).alias("bucket")
    hashes = df.select(bucket, *[_row_hash(df.columns, seed).cast(wide).alias(name) for seed, name in ((1, "one"), (2, "two"))])
    return hashes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))


def differing_buckets(a: DataFrame, b: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The buckets whose digests differ, `buckets` of them at most."""
    sides = bucket_digests(a, buckets).withColumn("_s", F.lit(1)).unionByName(bucket_digests(b, buckets).withColumn("_s", F.lit(-1)))
    sums = [F.sum(F.col(c) * F.col("_s")).alias(c) for c in ("n", "one", "two")]
    return sides.groupBy("bucket").agg(*sums).where("n <> 0 or one <> 0 or two <> 0").select("bucket")


def result_diff(a: DataFrame, b: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """Rows that one result has more often than the other: the columns, `side` and `times`.

    Order does not matter, duplicates count, NULLs are equal. Equal results give no row. A tree of
    two levels is compared from the top: each side is reduced to digests of its buckets, and only the
    rows of buckets that differ are shuffled, after partial aggregation. Where none differs, no row is
    shuffled and none is read a second time. Rows whose bucket has an equal number and equal sums
    of two 64-bit hashes on both sides count as equal.
    """
    wanted = F.broadcast(differing_buckets(a, b, buckets))  # at most `buckets` numbers

    def some(df: DataFrame, sign: int) -> DataFrame:
        bucket = F.pmod(_row_hash(df.columns, 0), F.lit(buckets))
        return df.withColumn("_b", bucket).join(wanted, F.col("_b") == F.col("bucket"), "left_semi").drop("_b").withColumn("_n", F.lit(sign))

    both = some(a, 1).unionByName(some(b.select(*[F.col(f"`{c}`") for c in a.columns]), -1))
    more = both.groupBy(*[F.col(f"`{c}`") for c in a.columns]).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return more.withColumns(
        {"side": F.when(F.col("_n") > 0, "left_only").otherwise("right_only"), "times": F.abs("_n")}
    ).drop("_n")


def files_missing(spark: SparkSession, expected: DataFrame, prefix: str) -> DataFrame:
    """Of `expected(folder)`, the folders below `prefix` that hold no file, also not further down; complete if none.

    The folders are dealt over tasks, and each task looks into its own, so no listing of all files is
    held anywhere. Files and folders whose names begin with `_` or `.` do not count; asking for
    one raises an error. A prefix or a folder that does not exist holds no file.
    """
    root = qualified(spark, prefix)
    hidden = F.col("folder").rlike(HIDDEN)
    asked = expected.select(F.when(hidden, F.raise_error(F.lit("hidden names are not listed"))).otherwise(F.col("folder")).alias("folder"))

    def holds_file(store: pafs.FileSystem, folder: str) -> bool:
        inner = []
        for entry in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if entry.base_name.startswith(("_", ".")):
                continue
            if entry.type == pafs.FileType.File:
                return True
            inner.append(entry.path)
        return any(holds_file(store, path) for path in inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(root)
        for batch in batches:
            empty = [f is None or not holds_file(store, f"{top}/{f}" if f else top) for f in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(empty, pa.bool_()))

    return asked.distinct().mapInArrow(run, "folder string")


def table_partitions(spark: SparkSession, table: str) -> DataFrame:
    """The partitions of a table as rows, from the catalogue; values are text, as the folders spell them."""
    names = [c.name for c in spark.catalog.listColumns(quoted(table)) if c.isPartition]
    parts = spark.sql(f"SHOW PARTITIONS {quoted(table)}").select(F.split("partition", "/").alias("_p"))

    def value(k: int) -> Column:
        text = F.substr(F.get("_p", F.lit(k)), F.instr(F.get("_p", F.lit(k)), "=") + 1)
        # Folder names escape characters as %XX but leave the plus sign.
        return F.nullif(F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), F.lit(NULL_PARTITION))

    return parts.select(*[value(k).alias(name) for k, name in enumerate(names)])


def partitions_missing(spark: SparkSession, table: str, values: Sequence[DataFrame]) -> DataFrame:
    """Of all combinations of the `values` (one single-column list each, of metadata size), those that are no partition of the table.

    What is there is said by the catalogue: no data file is listed or opened. A partition that is
    registered counts as there, also when it has no rows; a folder that is not registered
    (`MSCK REPAIR TABLE` would do so) does not. Values are compared as text; NULL is a value.
    """
    asked = values[0].distinct()
    for other in values[1:]:
        asked = asked.crossJoin(other.distinct())
    there = table_partitions(spark, table)
    same = [F.col(f"a.`{c}`").cast("string").eqNullSafe(F.col(f"t.`{c}`")) for c in asked.columns]
    match = same[0]
    for one in same[1:]:
        match = match & one
    return asked.alias("a").join(there.alias("t"), match, "left_anti")
