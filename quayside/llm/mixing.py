"""Mixing sources to target weights by nested hash thresholds, without sorting any document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm._shared import WORD, attach, numbered
from quayside.workspace import written

HASH_BITS = 60
LEVEL_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def document_hash(doc_id: Column, text: Column) -> Column:
    """A stable hash below 2^HASH_BITS; the text tells rows without an id apart."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 64 - HASH_BITS)


def _sized(docs: DataFrame) -> DataFrame:
    """`_src` stands for the source and is never null."""
    return docs.withColumns(
        {
            "_src": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
            "_size": word_count(F.col("text")),
            "_h": document_hash(F.col("doc_id"), F.col("text")),
        }
    )


def _targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """`sources` with `target`: the budget shared by weight, no target above `most` times its size.

    Only sums come to the driver. The level (target per weight) rises from round to round until no
    further source is full.
    """
    ranked = numbered(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_rank", "sources")
    weight = F.element_at(F.array([F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = written(
        ranked.select("_src", "source_size", "_rows", weight.alias("_w"), (F.lit(most) * F.col("source_size")).alias("_cap")),
        "weighed",
    )
    budget = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level = 0.0
    while True:
        full = F.col("_cap") <= F.col("_w") * level
        row = weighed.agg(F.sum(F.when(full, F.col("_cap"))).alias("c"), F.sum(F.when(~full, F.col("_w"))).alias("w")).first()
        risen = (budget - (row["c"] or 0.0)) / row["w"] if row["w"] else level
        if risen <= level:
            break
        level = risen
    return weighed.withColumn("target", F.least("_cap", F.col("_w") * level)).drop("_w", "_cap")


def mixing_plan(
    docs: DataFrame, *, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0
) -> tuple[DataFrame, DataFrame]:
    """The narrow rows of `docs` and one row per source: `_src, source_size, target, _whole, _below`.

    A source's target is `_whole` times all its documents plus a part of them: those with a hash
    below `_below`. The part is found by histograms. The first sums the words of each source by the
    top LEVEL_BITS bits of the hash; the budget ends inside one bucket, and only that bucket is
    split by the next bits, until it holds one document. That one is taken if at least half of it
    fits. A histogram has at most 2^LEVEL_BITS rows per source, whatever the documents.
    """
    rows = written(_sized(docs).select("doc_id", "_src", "source", "_size", "_h"), "sizes")
    sources = rows.groupBy("_src", "source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    targets = _targets(sources, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = written(
        targets.withColumn("_whole", F.floor(rate))
        .withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumns({"_at": F.lit(0).cast("bigint"), "_below": F.lit(None).cast("bigint")}),
        "thresholds",
    )
    by_source = Window.partitionBy("_src")
    before = by_source.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        open_ = state.where("_below is null").select("_src", "_rows", "_left", "_at")
        inside = attach(rows.select("_src", "_size", "_h"), open_, "_src", "_rows", F.col("_h")).where(
            F.shiftright("_h", shift + LEVEL_BITS) == F.col("_at")
        )
        buckets = inside.groupBy("_src", F.shiftright("_h", shift).alias("_bucket")).agg(
            F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_n"), F.first("_left").alias("_left")
        )
        summed = buckets.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
        # The bucket in which the budget ends; a source whose documents all fit has none.
        ends = (
            summed.where((F.col("_before") <= F.col("_left")) & (F.col("_before") + F.col("_words") > F.col("_left")))
            .groupBy("_src")
            .agg(F.min(F.struct("_bucket", "_before", "_words", "_n")).alias("e"))
        )
        last = (F.col("e._n") == 1) | F.lit(shift == 0)
        fits = (F.col("_left") - F.col("e._before")) * 2 >= F.col("e._words")
        stop = (
            F.when(F.col("e").isNull(), F.lit(1 << HASH_BITS))
            .when(last, F.shiftleft(F.col("e._bucket") + fits.cast("bigint"), shift))
        )
        is_open = F.col("_below").isNull()
        state = written(
            state.join(ends, "_src", "left").select(
                "_src", "source_size", "_rows", "target", "_whole",
                F.when(is_open & F.col("e").isNotNull(), F.col("_left") - F.col("e._before")).otherwise(F.col("_left")).alias("_left"),
                F.when(is_open, F.col("e._bucket")).otherwise(F.col("_at")).alias("_at"),
                F.when(is_open, stop).otherwise(F.col("_below")).alias("_below"),
            ),
            "thresholds",
        )
        if not state.where("_below is null").limit(1).count():
            break
    return rows, state


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    found = attach(rows, plan.select("_src", "_rows", "source_size", "target", "_whole", "_below"), "_src", "_rows", F.col("_h"))
    return found.withColumn("_copies", F.col("_whole") + (F.col("_h") < F.col("_below")).cast("bigint"))


def mix(docs: DataFrame, *, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """One row per row of `docs(doc_id, text, source, ...)`: `doc_id, size, source_size, target, taken, source, copies`.

    Sources in code point order, null last, weigh `weights` in turn and share `share` of all words;
    no target is above `most` times its source. `taken` is `size` times `copies`, the number of
    times the mix holds the document, which is at most `most` rounded up to a whole number.
    Thresholds and hashes make the choice, so a rerun makes the same one. A null text has no words.
    Repeated rows have the same hash and are taken or left together. Other columns are ignored; an
    empty table has no rows.
    """
    rows, plan = mixing_plan(docs, weights=weights, share=share, most=most)
    return _copies(rows, plan).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"),
        "source", F.col("_copies").alias("copies"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """`docs` as the mix has them: each row as many times as the mix takes it. All columns are kept as they are, whatever their names."""
    plan = mixing_plan(docs)[1]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "source")
    copies = _copies(_sized(rows).drop("text"), plan).where("_copies > 0")
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
