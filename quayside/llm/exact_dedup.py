"""Exact deduplication by a 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm._shared import WHITE_SPACE, attach
from quayside.workspace import written


def normalised(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


Hash = Callable[[Column], Column]


def _keyed(docs: DataFrame, content_hash: Hash, bad: DataFrame | None) -> DataFrame:
    """`docs(text, ...)` with `_t`, the normalised text, and `_k`, its hash, or hash and bytes for a hash of `bad`."""
    rows = docs.withColumn("_t", normalised(F.col("text"))).withColumn("_k", content_hash(F.col("_t")).cast("binary"))
    if bad is None:
        return rows
    known = bad.select(F.col("_k").alias("_b"))
    return rows.join(known, F.col("_k") == F.col("_b"), "left").withColumn(
        "_k", F.when(F.col("_b").isNull(), F.col("_k")).otherwise(F.concat("_k", F.col("_t").cast("binary")))
    ).drop("_b")


def _classes(docs: DataFrame, content_hash: Hash) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The narrow rows of `docs`, `(doc_id, _k, text_sha256)`; the classes of more than one row, `(_k, keep_id, group_size)`;
    and the hashes that several texts share, if any.

    A first pass groups hashes and ids alone. Only texts whose hash occurs twice are then compared byte by byte:
    partial aggregation leaves one copy of a text per task, and a hash with two texts is a collision,
    so from then on its rows are told apart by hash and text.
    """
    source, bad = docs.select("doc_id", "text"), None
    while True:
        keyed = _keyed(source, content_hash, bad)
        rows = written(keyed.select("doc_id", "_k", F.sha2("_t", 256).alias("text_sha256")), "hashes")
        classes = rows.groupBy("_k").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        classes = written(classes.where("group_size > 1"), "copies")
        if bad is not None:
            return rows, classes, bad
        texts = attach(keyed.select("_k", "_t", "doc_id"), classes.select("_k", "group_size"), "_k", "group_size", F.col("doc_id"))
        several = texts.where("group_size is not null").select("_k", "_t").distinct().groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
        collided = written(several.where("_n > 1"), "collided")
        if not collided.limit(1).count():
            return rows, classes, None
        bad = collided


def exact_duplicates(docs: DataFrame, content_hash: Hash = hash128) -> DataFrame:
    """One row per row of `docs(doc_id, text, ...)`: `doc_id, keep_id, group_size, kept, text_sha256`.

    Rows are grouped by `content_hash` of the normalised text, the smallest id of a group stays, and
    the bytes are compared inside groups (`_classes`). Partial aggregation leaves one row per group
    and map task, so a group that holds a third of all rows is no hot key; ids go back to the
    rows by a broadcast where there are few groups, else by `join_by_key`.

    A null text counts as empty. Of repeated rows with the same smallest id all are marked as kept, because
    ids alone tell these rows apart (`drop_copies` keeps one); a null id is never the smallest unless the group has no
    other, and then `keep_id` is null and its rows are kept. Other columns of `docs` are ignored.
    """
    rows, classes, _ = _classes(docs, content_hash)
    found = attach(rows, classes, "_k", "group_size", F.col("doc_id"))
    single = F.col("group_size").isNull()
    keep_id = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, content_hash: Hash = hash128) -> DataFrame:
    """`docs` with one row of each group of equal normalised texts: one with the smallest id; a null id counts only where all are null.

    Every row is judged by its own text, so another text under the same id stays, and of rows that
    repeat id and text one does. All columns are kept as they are, whatever their names.
    """
    rows, classes, bad = _classes(docs, content_hash)
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    winners = attach(rows, classes, "_k", "group_size", F.col("doc_id")).where("group_size is not null").where(first)
    repeated = winners.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count() > 0
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    found = attach(_keyed(marked, content_hash, bad).drop("_t", "text"), classes, "_k", "group_size", F.col("doc_id"))
    if not repeated:
        return found.where(F.col("group_size").isNull() | first).select("_row.*")
    once = found.where("group_size is not null").where(first).groupBy("_k").agg(F.first("_row").alias("_row"))
    return found.where("group_size is null").select("_row.*").unionByName(once.select("_row.*"))
