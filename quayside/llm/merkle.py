"""Merkle manifest of a table: superblocks of leaves meet their outer nodes, and are reduced, proved and folded there."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from quayside.llm._shared import attach, numbered
from quayside.workspace import written

FANOUT = 8
LEVELS = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# The letters that tampering changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODES = "tree string, idx bigint, n bigint, digest binary"
# What lies above a node: at each level its place in the run and the digests of the others of the run.
OUTER = "tree string, idx bigint, subroot string, at array<int>, others array<string>"


def combined(digests: Sequence[str]) -> str:
    """The node above a run of nodes."""
    return sha256("".join(digests).encode()).hexdigest()


def folded(digest: str, at: Sequence[int], others: Sequence[str]) -> str:
    """The node that `digest` leads to when at each level it takes its place among the others of its run."""
    for place, run in zip(at, others):
        cut = 64 * int(place)
        digest = sha256((run[:cut] + digest + run[cut:]).encode()).hexdigest()
    return digest


def depth(n: int) -> int:
    """Levels above the `n` leaves of a tree."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the values one after the other, each as its length in bytes, a colon and the value, or `-` if null."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def in_lower_case(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


@dataclass
class _Block:
    """The inner nodes of one superblock: `levels[k]` are its nodes k levels above its own."""

    levels: list[list[str]]

    @classmethod
    def over(cls, digests: list[str], n: int, levels: int) -> _Block:
        nodes = [digests]
        for _ in range(min(levels, depth(n))):
            below = nodes[-1]
            nodes.append([combined(below[k : k + FANOUT]) for k in range(0, len(below), FANOUT)])
        return cls(nodes)

    def path(self, place: int) -> tuple[list[int], list[str]]:
        """Places and the others of the runs from a node of the lowest level up to the block's top."""
        at, others = [], []
        for nodes in self.levels[:-1]:
            first = place - place % FANOUT
            at.append(place - first)
            others.append("".join(nodes[first:place] + nodes[place + 1 : first + FANOUT]))
            place //= FANOUT
        return at, others


def _ordered(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[str]]:
    rows = rows.sort_values("idx")
    return rows, [bytes(x).hex() for x in rows["digest"]]


def _superblock(levels: int) -> Column:
    return F.shiftright("idx", 3 * levels).alias("block")


def _reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """The tops of all superblocks of `nodes` (NODES), `levels` levels higher or the top of their tree."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, digests = _ordered(rows)
        n = int(rows["n"].iloc[0])
        block = _Block.over(digests, n, levels)
        above = n
        for _ in range(len(block.levels) - 1):
            above = -(-above // FANOUT)
        top = {"tree": rows["tree"].iloc[0], "idx": int(rows["idx"].iloc[0]) >> 3 * levels, "n": above, "digest": bytes.fromhex(block.levels[-1][0])}
        return pd.DataFrame([top])

    return nodes.groupBy("tree", _superblock(levels)).applyInPandas(run, NODES)


def _stages(nodes: DataFrame, levels: int, label: str) -> list[DataFrame]:
    """`nodes` and, `levels` levels further up each, the tops of their superblocks, until each tree has one node.

    A stage has one row per superblock of the stage below, so the rounds are the logarithm of the
    largest tree to the base of 8^levels.
    """
    stages = [nodes]
    while stages[-1].agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] > 1:
        stages.append(written(_reduced(stages[-1].select("tree", "idx", "n", "digest"), levels), label))
    return stages


def _descended(nodes: DataFrame, above: DataFrame, levels: int, label: str, *, entering: str | None = None) -> DataFrame:
    """What lies above each node of `nodes` (OUTER), from what lies above their superblocks.

    Nodes and the outer nodes of their superblock are cogrouped; a node's path is its path inside
    the superblock and then the superblock's own. With `entering`, nodes are the tops of the trees
    that this column names, and what is returned lies above those.
    """

    def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows, digests = _ordered(rows)
        block, top = _Block.over(digests, int(rows["n"].iloc[0]), levels), outer.iloc[0]
        paths = [block.path(k) for k in range(len(digests))]
        return pd.DataFrame(
            {
                "tree": rows[entering or "tree"].to_numpy(),
                "idx": 0 if entering else rows["idx"].to_numpy(),
                "subroot": digests if entering else top["subroot"],
                "at": [at + list(top["at"]) for at, _ in paths],
                "others": [others + list(top["others"]) for _, others in paths],
            }
        )

    return written(_cogrouped(nodes, above, levels).applyInPandas(run, OUTER), label)


def _cogrouped(nodes: DataFrame, above: DataFrame, levels: int) -> PandasCogroupedOps:
    """Nodes and what lies above their superblock, by superblock."""
    blocks = nodes.groupBy("tree", _superblock(levels))
    return blocks.cogroup(above.groupBy("tree", F.col("idx").alias("block")))


def _above(stages: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """What lies above the superblocks of the first stage, `tops` being what lies above the trees."""
    found = tops
    for stage in reversed(stages[1:]):
        found = _descended(stage, found, levels, "above")
    return found


def _placed(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """`rows` with `idx`, their place in their tree by `order`, and `n`, the size of the tree.

    One distributed sort numbers all rows, trees one after the other, so a tree that holds a third
    of all rows is dealt over tasks like any other; a tree's first number is taken off.
    """
    kept = numbered(rows, ["tree", *order], "_seat", label)
    trees = written(kept.groupBy("tree").agg(F.min("_seat").alias("_first"), F.count(F.lit(1)).alias("n")), "trees")
    sized = trees.withColumn("_rows", F.col("n"))
    return attach(kept, sized, "tree", "_rows", F.col("_seat")).withColumn("idx", F.col("_seat") - F.col("_first")).drop("_seat", "_first", "_rows")


MANIFEST = (
    "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean,"
    " proof_at array<int>, proof_others array<string>"
)


def manifest(docs: DataFrame, *, claimed: Column | None = None, levels: int = LEVELS, with_proofs: bool = False) -> DataFrame:
    """One row per row of `docs(doc_id, text, lang, source, n_chars, ...)`: MANIFEST.

    A row's leaf is `leaf_digest` of COLUMNS. Each lang is a tree over its leaves by doc_id; while
    there are several nodes, every FANOUT consecutive ones become their hash. The subroots of the
    langs, null first, then by UTF-8 bytes, are the leaves of the tree that ends in `root`.
    `proof_sha256` hashes the siblings of all levels up to the root; `folded_root` is what the leaf
    of the row, with the text that `claimed` says it has (default: its own), leads to with these
    siblings, and `verified` whether that is `root`. `with_proofs` adds the siblings themselves, as
    `folded` takes them; else both columns are null.

    Superblocks of FANOUT^levels leaves are reduced to their tops first, and these to theirs, up to
    the root; on the way back, nodes and what lies above their superblock are cogrouped, and for
    the leaves that finishes reduction, proof and folding in one place. So no task holds more
    than a superblock, digests alone are shuffled, and a hot lang is many superblocks.

    Null doc_ids come first; equal doc_ids of a lang are ordered by their leaves. Repeated rows are leaves of
    their own, each with a proof. A null text stays null when tampered with. Other columns are
    ignored. An empty table has no rows, and so no root.
    """
    if levels < 1:
        raise ValueError("a superblock has at least one level")
    columns = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")]
    leaves = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        leaf_digest(columns).alias("digest"),
        leaf_digest([*columns[:-1], F.col("text") if claimed is None else claimed]).alias("claim"),
    )
    # Written first, because finding the ranges reads the leaves once more.
    hashed = written(leaves.withColumn("claim", F.nullif("claim", "digest")), "leaves")
    placed = written(_placed(hashed, ["doc_id", "digest"], "leaves"), "leaves")
    inner = _stages(placed, levels, "nodes")
    tops = inner[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest")
    subroots = written(_placed(tops, ["lang"], "subroots"), "subroots")
    upper = _stages(subroots, levels, "langs")
    root = upper[-1].select("digest").first()
    if root is None:
        return docs.sparkSession.createDataFrame([], MANIFEST)
    start = docs.sparkSession.createDataFrame([("", 0, "", [], [])], OUTER)
    per_lang = _descended(subroots, _above(upper, start, levels), levels, "above", entering="lang")
    return _finished(placed, _above(inner, per_lang, levels), bytes(root["digest"]).hex(), levels, with_proofs)


def _finished(leaves: DataFrame, above: DataFrame, root: str, levels: int, with_proofs: bool) -> DataFrame:
    """Leaves and what lies above their superblocks, cogrouped: local reduction, proofs and folding."""

    def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows, digests = _ordered(rows)
        block, top = _Block.over(digests, int(rows["n"].iloc[0]), levels), outer.iloc[0]
        at_top, others_top = list(top["at"]), list(top["others"])
        tail = "".join(others_top)
        proofs, ends, places, runs = [], [], [], []
        for k, (digest, claim) in enumerate(zip(digests, rows["claim"])):
            at, others = block.path(k)
            proofs.append(sha256(("".join(others) + tail).encode()).hexdigest())
            ends.append(folded(folded(digest if claim is None else bytes(claim).hex(), at, others), at_top, others_top))
            if with_proofs:
                places.append(at + at_top)
                runs.append(others + others_top)
        return pd.DataFrame(
            {
                # Pandas would make floats of ids with a null among them.
                "doc_id": pd.arrays.IntegerArray(rows["id"].to_numpy("int64"), rows["no_id"].to_numpy(bool)),
                "leaf": digests,
                "subroot": top["subroot"],
                "root": root,
                "proof_sha256": proofs,
                "folded_root": ends,
                "verified": [end == root for end in ends],
                "proof_at": places or None,
                "proof_others": runs or None,
            }
        )

    rows = leaves.select("tree", "idx", "n", "digest", "claim", F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("no_id"))
    return _cogrouped(rows, above, levels).applyInPandas(run, MANIFEST)
