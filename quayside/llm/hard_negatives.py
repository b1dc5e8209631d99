"""Hard negatives: scores bounded along spanning trees of anchors, exact only where the bounds reach a window."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.llm._shared import numbered
from quayside.workspace import written

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80
TREE_ANCHORS = 256
PASS_BYTES = 16 << 20
BLOCK_ROWS = 4096
CODE_COMPONENTS = 16
# Whole numbers up to this are exact as floats.
EXACT = 2**53


def usable(vectors: DataFrame) -> DataFrame:
    """`(vec_id, label, embedding)` of the rows that take part, one for each vec_id.

    A null vec_id, label, vector or component, or one that is not finite, keeps a row out. Of rows
    with the same vec_id the one with the smallest label, then vector, counts; only ids are
    shuffled to find whether there are any.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    repeated = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("vec_id")
    if not repeated.limit(1).count():
        return rows
    repeated = written(repeated, "repeated")
    first = F.min(F.struct("label", "embedding")).alias("v")
    one = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(first).select("vec_id", "v.label", "v.embedding")
    return written(rows.join(repeated, "vec_id", "left_anti").unionByName(one), "vectors")


def whole(embeddings: np.ndarray, scale: float) -> np.ndarray:
    """Components as whole numbers, as floats."""
    return np.floor(embeddings * scale)


def _matrix(vectors: pa.ListArray, dimensions: int, scale: float) -> np.ndarray:
    """Vectors as rows of whole numbers; a shorter vector ends with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy()
    if len(lengths) and (lengths == dimensions).all():
        return whole(values.reshape(len(lengths), dimensions), scale)
    out = np.zeros((len(lengths), dimensions))
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = whole(values, scale)
    return out


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree: points in an order in which each follows its parent, the parents'
    places in that order (-1 for the first) and the lengths of the edges."""
    n = len(points)
    squares = (points * points).sum(1)

    def distances(k: int) -> np.ndarray:
        return np.sqrt(np.maximum(squares + squares[k] - 2 * points @ points[k], 0))

    order, place = [0], {0: 0}
    parent, length = [-1], [0.0]
    nearest, best = np.zeros(n, np.int64), distances(0)
    best[0] = np.inf
    while len(order) < n:
        k = int(np.argmin(best))
        parent.append(place[int(nearest[k])])
        # The length is computed anew from the difference, which loses no digits.
        length.append(float(np.sqrt(((points[k] - points[nearest[k]]) ** 2).sum())))
        place[k] = len(order)
        order.append(k)
        best[k] = np.inf
        new = distances(k)
        closer = (new < best) & np.isfinite(best)
        best[closer], nearest[closer] = new[closer], k
    return np.array(order), np.array(parent), np.array(length)


TREES = "tree bigint, place int, vec_id bigint, label bigint, point binary, parent int, length double"


def anchor_trees(anchors: DataFrame, dimensions: int, scale: float) -> DataFrame:
    """Anchors (usable rows) in spanning trees of at most TREE_ANCHORS each: TREES.

    Anchors with the same signs in their first components are put into the same trees, so edges are
    short where anchors are similar. A distributed sort deals them, and a task makes a tree.
    """
    signs = F.transform(F.slice("embedding", 1, CODE_COMPONENTS), lambda x: F.when(x < 0, "0").otherwise("1"))
    placed = numbered(anchors.withColumn("_code", F.array_join(signs, "")), ["_code", "vec_id"], "_seat", "anchors")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_seat")
        points = _matrix(pa.array(rows["embedding"], pa.list_(pa.float64())), dimensions, scale)
        order, parent, length = spanning_tree(points)
        made = rows.iloc[order].assign(place=np.arange(len(rows)), point=[p.tobytes() for p in points[order]], parent=parent, length=length)
        return made[[c.split()[0] for c in TREES.split(", ")]]

    dealt = placed.withColumn("tree", F.floor(F.col("_seat") / TREE_ANCHORS).cast("bigint"))
    return written(dealt.groupBy("tree").applyInPandas(build, TREES), "trees")


@dataclass
class Trees:
    """The trees of one pass over the rows, with the vectors of their anchors as whole numbers."""

    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    parent: np.ndarray
    length: np.ndarray
    #: Where each tree begins, and the end.
    starts: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame, dimensions: int) -> Trees:
        rows = rows.sort_values(["tree", "place"])
        starts = np.flatnonzero(rows["place"].to_numpy() == 0)
        points = np.frombuffer(b"".join(map(bytes, rows["point"])), np.float64).reshape(len(rows), dimensions)
        return cls(
            rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), points,
            rows["parent"].to_numpy(np.int64), rows["length"].to_numpy(np.float64), np.append(starts, len(rows)),
        )


@dataclass
class Bests:
    """The best rows seen so far for each of some questions: scores and ids, best first."""

    scores: np.ndarray
    ids: np.ndarray

    @classmethod
    def none(cls, questions: int, most: int) -> Bests:
        return cls(np.full((questions, most), -np.inf), np.zeros((questions, most), np.int64))

    def least(self, question: int) -> float:
        """A row with a lower score is not among the best."""
        return self.scores[question, -1]

    def add(self, question: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.scores[question, -1]
        if not good.any():
            return
        held = np.isfinite(self.scores[question])
        scores = np.concatenate([self.scores[question][held], scores[good]])
        ids = np.concatenate([self.ids[question][held], ids[good]])
        order = np.lexsort((ids, -scores))[: self.ids.shape[1]]
        self.scores[question, : len(order)], self.ids[question, : len(order)] = scores[order], ids[order]


def walk(
    trees: Trees, ids: np.ndarray, labels: np.ndarray, points: np.ndarray,
    window: Callable[[int], tuple[float, float]], eligible: Callable[[int, np.ndarray, np.ndarray], np.ndarray], take: Callable[[int, np.ndarray, np.ndarray], None],
) -> int:
    """Score a block of rows for all anchors, tree by tree; the number of exact scores.

    The first anchor of a tree is scored with all rows. For every other, the scores at its parent
    plus or minus the length of the edge times the norm of a row bound the row's score; rows that are
    `eligible` and whose bounds reach the anchor's `window` are scored exactly and given to `take`.
    An exact score is its own bound for the children.
    """
    norms, largest = np.sqrt((points * points).sum(1)), float(np.abs(points).max(initial=0))
    scored = 0
    for start, end in zip(trees.starts[:-1].tolist(), trees.starts[1:].tolist()):
        low, high = np.empty((end - start, len(ids))), np.empty((end - start, len(ids)))
        for k in range(start, end):
            anchor = trees.points[k]
            own = k - start
            bound = largest * float(np.abs(anchor).max(initial=0)) * len(anchor)
            if bound >= EXACT:
                raise ValueError("the components are too large for exact scores")
            if own:
                up = trees.parent[k]
                # A little more than the bound, for the rounding of norms and lengths.
                reach = norms * (trees.length[k] * (1 + 1e-9)) + (1 + 1e-9 * bound)
                np.subtract(low[up], reach, out=low[own])
                np.add(high[up], reach, out=high[own])
                least, most = window(k)
                near = np.flatnonzero(eligible(k, ids, labels) & (high[own] >= least) & (low[own] <= most))
            else:
                near = np.arange(len(ids))
            if len(near):
                found = (points if len(near) == len(ids) else points[near]) @ anchor
                low[own, near] = high[own, near] = found
                scored += len(near)
                if not own:
                    fit = eligible(k, ids, labels)
                    near, found = near[fit], found[fit]
                take(k, near, found)
    return scored


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), dimensions, scale)


def _passes(trees: DataFrame, dimensions: int) -> Iterator[DataFrame]:
    """The trees in parts whose vectors take about PASS_BYTES at most, whatever there are."""
    per_pass = max(1, PASS_BYTES // (8 * max(1, dimensions) * TREE_ANCHORS))
    count = trees.agg(F.coalesce(F.max("tree") + 1, F.lit(0))).first()[0]
    for first in range(0, count, per_pass):
        yield trees.where((F.col("tree") >= first) & (F.col("tree") < first + per_pass))


def _union(frames: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    if not frames:
        return spark.createDataFrame([], schema)
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


def _first(rows: DataFrame, by: list[str], score: str, row_id: str, most: int) -> DataFrame:
    """The best `most` rows of each group, ranked from 1; a group has as many from each task at most."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), row_id)))
    return ranked.where(F.col("rank") <= most)


POSITIVE = "anchor_id bigint, positive_id bigint, positive_score bigint"
NEGATIVE = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def _positives(rows: DataFrame, part: DataFrame, dimensions: int, scale: float, most: int) -> DataFrame:
    """For each anchor of `part` the best rows of its label of each task (POSITIVE)."""
    given = rows.sparkSession.sparkContext.broadcast(part.toPandas())  # at most PASS_BYTES and one tree of vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees.of(given.value, dimensions)
        best = Bests.none(len(trees.ids), most)
        for ids, labels, points in _blocks(batches, dimensions, scale):
            walk(
                trees, ids, labels, points,
                lambda k: (best.least(k), np.inf),
                lambda k, ids, labels: (labels == trees.labels[k]) & (ids != trees.ids[k]),
                lambda k, near, found: best.add(k, found, ids[near]),
            )
        k, at = np.nonzero(np.isfinite(best.scores))
        yield _batch([trees.ids[k], best.ids[k, at], best.scores[k, at]], POSITIVE)

    return rows.mapInArrow(run, POSITIVE)


def _batch(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64), pa.int64()) for c in columns], names=names)


def _negatives(rows: DataFrame, part: DataFrame, positives: DataFrame, dimensions: int, scale: float, least_percent: int, most: int) -> DataFrame:
    """For each positive of the anchors of `part` the best rows of other labels in its window of each task (NEGATIVE)."""
    own = positives.join(part.select(F.col("vec_id").alias("anchor_id")), "anchor_id", "left_semi")
    given = rows.sparkSession.sparkContext.broadcast((part.toPandas(), own.toPandas()))  # bounded as above, and some positives for each anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees.of(given.value[0], dimensions)
        asked = given.value[1].sort_values(["anchor_id", "positive_score"])
        of_anchor = dict(asked.groupby("anchor_id").indices)
        scores = asked["positive_score"].to_numpy(np.int64)
        questions = [of_anchor.get(a, np.zeros(0, np.int64)) for a in trees.ids.tolist()]
        # The window of a positive: at least that share of its score, and no more than the score.
        lows = -(-least_percent * scores // 100)
        best = Bests.none(len(asked), most)

        def window(k: int) -> tuple[float, float]:
            some = [q for q in questions[k] if lows[q] <= scores[q]]
            if not some:
                return np.inf, -np.inf
            return min(max(float(lows[q]), best.least(q)) for q in some), float(max(scores[q] for q in some))

        for ids, labels, points in _blocks(batches, dimensions, scale):

            def take(k: int, near: np.ndarray, found: np.ndarray) -> None:
                for q in questions[k]:
                    inside = (found >= lows[q]) & (found <= scores[q])
                    best.add(q, found[inside], ids[near[inside]])

            walk(trees, ids, labels, points, window, lambda k, ids, labels: labels != trees.labels[k], take)
        q, at = np.nonzero(np.isfinite(best.scores))
        yield _batch([asked["anchor_id"].to_numpy()[q], asked["positive_id"].to_numpy()[q], scores[q], best.ids[q, at], best.scores[q, at]], NEGATIVE)

    return rows.mapInArrow(run, NEGATIVE)


MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(
    vectors: DataFrame, is_anchor: Column, *, scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT
) -> DataFrame:
    """Hard negatives of the anchors among `vectors(vec_id, label, embedding, ...)`: MINED.

    A score is the inner product of two vectors, each component times `scale` and rounded down.
    An anchor's positives are the `positives` rows of its label, other than itself, with the highest
    scores. For each of them, the `negatives` rows of other labels are returned that have the highest scores
    from `least_percent` of the positive's to the positive's. Ties go to the smaller vec_id.

    Anchors are dealt into spanning trees (`anchor_trees`), and rows are read where they lie, in
    blocks: `walk` scores a block along the trees. Trees are broadcast in passes of a bounded size;
    each task returns its best rows per anchor, so that neither rows nor scores are shuffled. Every
    row is compared with every anchor, by bounds or exactly.

    Which rows take part is said by `usable`; a shorter vector counts as if it ended with zeros, an empty one
    has the score 0. An anchor without positives, and a positive without negatives, has no rows.
    Components so large that a score could pass 2^53 raise ValueError. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    dimensions = rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    trees = anchor_trees(rows.where(is_anchor), dimensions, scale)
    found = [_positives(rows, part, dimensions, scale, positives) for part in _passes(trees, dimensions)]
    near = _first(_union(found, spark, POSITIVE), ["anchor_id"], "positive_score", "positive_id", positives)
    near = written(near.drop("rank"), "positives")
    hard = [_negatives(rows, part, near, dimensions, scale, least_percent, negatives) for part in _passes(trees, dimensions)]
    ranked = _first(_union(hard, spark, NEGATIVE), ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
