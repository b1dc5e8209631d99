"""What several operators of this subpackage need: joins that stand hot keys, row numbers and connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.workspace import written

# The characters that separate words, and a word.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_by_key(
    left: DataFrame,
    right: DataFrame,
    key: str,
    rows: str,
    spread: Column,
    *,
    hot_share: float = 0.001,
) -> DataFrame:
    """Left join of `right`, which is unique on `key`, onto `left`; any key may be hot.

    `right[rows]` says how many rows of `left` have the key. Keys with more than `hot_share` of
    their sum are at most 1 / hot_share many, so these rows of `right` (which must be narrow) are
    broadcast. All other keys are joined by a shuffle in which no key is hot; the rows that the
    broadcast has served are dealt out by `spread` there. `key` is never null. `right` should be a
    written table, because it is read three times.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    values = [c for c in right.columns if c != key]
    packed = right.select(F.col(key).alias("_k"), F.struct(*values).alias("_v"), (F.col(rows) > total * hot_share).alias("_hot"))
    hot = packed.where("_hot").select(F.col("_k").alias("_hk"), F.col("_v").alias("_hv"))
    cold = packed.where("not _hot").select(F.col("_k").alias("_ck"), F.col("_v").alias("_cv"), F.lit(0).cast("bigint").alias("_cs"))
    served = left.withColumn("_s", spread).join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    dealt = served.withColumn("_s", F.when(F.col("_hk").isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64("_s").bitwiseOR(F.lit(1).cast("bigint"))))
    joined = dealt.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_s") == F.col("_cs")), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in left.columns],
        *[F.coalesce(F.col(f"_hv.`{c}`"), F.col(f"_cv.`{c}`")).alias(c) for c in values],
    )


def numbered(df: DataFrame, order: Sequence[str], name: str, label: str) -> DataFrame:
    """`df` written as a table sorted by `order`, with gapless numbers from 0 in that order.

    Ranges of the order go to separate tasks; one count per task is gathered.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(ranged.withColumn("_m", F.monotonically_increasing_id()), label)
    part = F.shiftright("_m", 33)
    counts = kept.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at")))  # one row per task
    return (
        kept.join(offsets, part == F.col("_p"))
        .withColumn(name, F.col("_at") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_m", "_p", "_at")
    )


SMALL_ROWS = 100_000


def attach(left: DataFrame, right: DataFrame, key: str, rows: str, spread: Column) -> DataFrame:
    """`join_by_key`, by a plain broadcast where `right` (narrow, written) has few rows."""
    if right.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        return join_by_key(left, right, key, rows, spread)
    return left.join(F.broadcast(right), key, "left").select(*left.columns, *[c for c in right.columns if c != key])


ROWS_PER_TASK = 500_000


def narrowed(df: DataFrame, rows: int, label: str) -> DataFrame:
    """`df`, of about `rows` narrow rows, written by as many tasks as that needs."""
    return written(df.coalesce(max(1, -(-rows // ROWS_PER_TASK))), label)


def components(links: DataFrame, label: str = "component") -> DataFrame:
    """`(node, component)` for every node of `links(a, b)`; component is the smallest node reached.

    Alternates the large-star and the small-star step until the edges stay the same. Only counts
    and sums come to the driver; each step is cut off by a written table. A hub may be hot: its
    neighbours' minimum is aggregated before the shuffle and handed back by `attach`.
    """

    def star(edges: DataFrame, large: bool, n: int) -> DataFrame:
        if large:
            near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        else:
            near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = narrowed(near.groupBy("u").agg(F.min("v").alias("_min"), F.count(F.lit(1)).alias("_n")), 2 * n, label)
        least = least.withColumn("m", F.least("_min", "u")).drop("_min")
        with_least = attach(near, least, "u", "_n", F.col("v"))
        if large:
            out = with_least.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = with_least.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        return narrowed(out.where("a <> b").distinct(), 2 * n, label)

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    seen = mark(edges)
    edges = narrowed(edges.distinct(), seen[0], label)
    seen = mark(edges)
    while seen[0]:
        edges = star(star(edges, True, seen[0]), False, seen[0])
        now = mark(edges)
        if now == seen:
            break
        seen = now
    lower = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return narrowed(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(lower), 2 * seen[0], label)
