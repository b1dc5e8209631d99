"""Similarity join on word n-grams: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm._memory import tidied, tidied_batches
from quayside.llm._shards import cuts, group_bytes, grouped_texts, ids_of, of_groups, shard_bits, summed, ungrouped, words_in
from quayside.llm._shared import attach, components, join_by_key
from quayside.llm._words import packed, shingles, unpacked
from quayside.workspace import written

WORDS = 5
PERCENT = 80
TOKEN_BITS = 56
ASKED_BITS = 40
CELLS = 16
BLOCK_ROWS = 256
BLOCK_TOKENS = 500_000
TASK_ROWS = 2048
TASK_TOKENS = 2_000_000
COLUMNS = 4096


def least_overlap(x: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Common n-grams that a set of `x` needs with any similar one."""
    return -(-percent * x // 100)


def _levels(counts: np.ndarray) -> np.ndarray:
    """How common n-grams are that as many texts have: 0 for one text, else four times the logarithm to base 2."""
    return np.minimum(4 * np.log2(np.maximum(counts, 1)), 255).astype(np.uint8)


def _set_keys(tokens: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """A 128-bit hash of each set; None for an empty one."""
    ends = np.cumsum(sizes)
    return [blake2b(tokens[a:b].tobytes(), digest_size=16).digest() if a < b else None for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def _asked(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The part of n-gram hashes that is counted: the `bits` that pick the shard and ASKED_BITS more."""
    return tokens >> np.uint64(max(0, TOKEN_BITS - ASKED_BITS - bits))


SETS = "doc_id bigint, content bigint, n bigint, key binary, alone int, prefix int, last int, tokens array<bigint>, cells array<int>"


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row per row of `docs`: SETS; the columns from `alone` on are null unless the row may have a partner.

    `n` is the size of the set of n-grams and `key` a hash of it. `tokens` are the n-grams that other texts
    have too, rare first; the `alone` others would come before them. A text with fewer of them than
    it needs in common with a similar one has no partner. `prefix` is how many of `tokens` lie in
    the prefix, `last` the level of the last of these, and `cells` counts `tokens` by hash for the suffix filter.

    All n-grams of all texts are counted: groups of texts send theirs to the shards of the hash space, where
    they are summed, and get back how common each is. An n-gram is one entry of a group however many of its texts have
    it, so none is hot, and equal sets of a group count once. Groups meet their answers by a shuffle.
    """
    keys = words_in(docs)
    bits = shard_bits(keys)
    key_bits = min(TOKEN_BITS, ASKED_BITS + bits)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    groups = grouped_texts(rows, group_bytes(keys))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, _, texts in of_groups(batches):
            tokens, sizes = shingles(texts, width, TOKEN_BITS)
            seen: set[bytes] = set()
            first = np.array([key is not None and not (key in seen or seen.add(key)) for key in _set_keys(tokens, sizes)], bool)
            asked, counts = np.unique(_asked(tokens, bits), return_counts=True)
            counts = np.zeros(len(asked), np.int64)
            np.add.at(counts, np.searchsorted(asked, _asked(tokens[np.repeat(first, sizes)], bits)), 1)
            edges = cuts(asked, bits, key_bits)
            out = []
            for shard, (a, b) in enumerate(zip(edges, edges[1:])):
                if a < b:
                    many = np.flatnonzero(counts[a:b] > 1)
                    out.append((shard, grp, packed(asked[a:b], ASKED_BITS // 8), many.astype(np.uint32).tobytes(), counts[a:b][many].astype(np.uint32).tobytes()))
            if out:
                types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["shard", "grp", "keys", "many", "times"])

    def answer(block: pd.DataFrame) -> pd.DataFrame:
        keys = [unpacked(x, ASKED_BITS // 8) for x in block["keys"]]
        counts = [np.ones(len(x), np.int64) for x in keys]
        for own, many, times in zip(counts, block["many"], block["times"]):
            own[np.frombuffer(many, np.uint32)] = np.frombuffer(times, np.uint32)
        _, sums, place = summed(keys, counts)
        ends = np.cumsum([len(x) for x in keys])
        levels = _levels(sums)[place]
        return pd.DataFrame({"grp": block["grp"], "shard": block["shard"], "levels": [x.tobytes() for x in np.split(levels, ends[:-1])]})

    def settle(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        meta, texts = ungrouped(group["meta"].iloc[0], group["texts"].iloc[0])
        tokens, sizes = shingles(texts, width, TOKEN_BITS)
        _, place = np.unique(_asked(tokens, bits), return_inverse=True)
        levels = np.frombuffer(b"".join(answers.sort_values("shard")["levels"]), np.uint8)[place]
        rows = np.repeat(np.arange(len(sizes)), sizes)
        need = least_overlap(sizes, percent)
        common = np.bincount(rows, levels > 0, len(sizes)).astype(np.int64)
        some = np.flatnonzero((sizes > 0) & (common >= need))
        out = pd.DataFrame({"doc_id": ids_of(meta, "doc_id"), "content": ids_of(meta, "content"), "n": sizes, "key": _set_keys(tokens, sizes)})
        kept = (levels > 0) & np.isin(rows, some)
        order = np.lexsort((tokens[kept], levels[kept], rows[kept]))
        ordered, level = tokens[kept][order].view(np.int64), levels[kept][order]
        ends = np.cumsum(common[some])
        alone = (sizes - common)[some]
        prefix = (sizes - need + 1)[some] - alone
        lists = np.split(ordered, ends[:-1]) if len(some) else []
        # A set's last prefix n-gram, by its place among all.
        last = level[ends - common[some] + prefix - 1] if len(some) else level
        columns = {
            "alone": alone, "prefix": prefix, "last": last,
            "tokens": lists, "cells": [np.bincount(x & (CELLS - 1), minlength=CELLS) for x in lists],
        }
        for name, values in columns.items():
            column = np.full(len(out), None, object)
            for k, value in zip(some.tolist(), values):
                column[k] = value
            out[name] = column
        return out

    asked = groups.mapInArrow(tidied_batches(ask), "shard int, grp bigint, keys binary, many binary, times binary")
    answers = asked.groupBy("shard").applyInPandas(lambda block: tidied(answer, block), "grp bigint, shard int, levels binary")
    return groups.groupBy("grp").cogroup(answers.groupBy("grp")).applyInPandas(lambda group, answers: tidied(settle, group, answers), SETS)


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Common n-grams of each of `x` with each of `y`."""
    out = np.zeros((len(x), len(y)), np.float32)
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        tokens, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(t) for t in sets])
        at = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
        there = shared[at] == tokens
        at, row = at[there], row[there]
        order = np.argsort(at)
        return at[order], row[order]

    if len(shared):
        (ax, rx), (ay, ry) = places(x), places(y)
        for start in range(0, len(shared), COLUMNS):
            parts = []
            for at, row, n in ((ax, rx, len(x)), (ay, ry, len(y))):
                some = slice(*np.searchsorted(at, [start, start + COLUMNS]))
                part = np.zeros((n, min(COLUMNS, len(shared) - start)), np.float32)
                part[row[some], at[some] - start] = 1
                parts.append(part)
            out += parts[0] @ parts[1].T
    return out


class _Block:
    """The sets of one block, as arrays."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.node, self.n = rows["node"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        self.tokens = [np.asarray(t, np.int64) for t in rows["tokens"]]
        self.prefix = [t[:p] for t, p in zip(self.tokens, rows["prefix"])]
        # What lies behind the prefix, and the place of its last n-gram in the order of all: rare first, then by hash.
        self.behind = self.n - rows["alone"].to_numpy(np.int64) - rows["prefix"].to_numpy(np.int64)
        self.last = rows["last"].to_numpy(np.int64), np.array([p[-1] for p in self.prefix], np.int64)
        self.cells = np.stack([np.asarray(c, np.int64) for c in rows["cells"]])


def _links(a: _Block, b: _Block, percent: int, same: bool) -> np.ndarray:
    """Which sets of `a` link with which of `b`; of a block with itself each pair once.

    Pairs that share a prefix n-gram are filtered by length, by position and by suffix, and those
    left are verified. Behind the prefix that ends first in the order of all n-grams, a pair has at most
    as many n-grams in common as lie there, so that the common ones of the prefixes and these bound all.
    """
    need = (a.n[:, None] + b.n[None, :]) * percent  # of 100 + percent times the common ones
    common = _overlaps(a.prefix, b.prefix).astype(np.int64)
    (level, token), (other_level, other_token) = a.last, b.last
    first = (level[:, None] < other_level) | (level[:, None] == other_level) & (token[:, None] <= other_token)
    behind = np.where(first, a.behind[:, None], b.behind[None, :])
    near = (common > 0) & (np.minimum(a.n[:, None], b.n) * 100 >= np.maximum(a.n[:, None], b.n) * percent)
    near &= (common + behind) * (100 + percent) >= need
    if same:
        near = np.triu(near, 1)
    x, y = np.nonzero(near)
    most = np.minimum(a.cells[x], b.cells[y]).sum(1)
    near[x, y] = most * (100 + percent) >= need[x, y]
    x, y = np.nonzero(near)
    if len(x):
        rows, columns = np.unique(x), np.unique(y)
        overlap = _overlaps([a.tokens[k] for k in rows], [b.tokens[k] for k in columns])
        near[x, y] = overlap[np.searchsorted(rows, x), np.searchsorted(columns, y)] * (100 + percent) >= need[x, y]
    return near


def _lowest(nodes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest node that each of `nodes` reaches by the links between places `x` and `y`."""
    low = nodes.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, x, before[y])
        np.minimum.at(low, y, before[x])
        if (low == before).all():
            return low


def _candidates(sets: DataFrame) -> DataFrame:
    """`(block, node, ...)`: the candidate sets in blocks, and beside them which pairs of blocks have to be compared.

    Each prefix n-gram has a list of sets. The home of a set is the longest list it is on, the
    first in order of about equally long ones, so sets that are similar share a home as a rule. A home is dealt into
    blocks of about BLOCK_ROWS sets.
    """
    entries = sets.select("node", "n", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("token"))
    lists = written(entries.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "lists")
    listed = attach(entries, lists.withColumn("length", F.col("_n")), "token", "_n", F.col("node")).where("length is not null").drop("_n")
    return written(listed, "entries")


def _blocks(sets: DataFrame, entries: DataFrame) -> DataFrame:
    """`(node, block)`: each set that is on some list in a block of its home."""
    home = F.min(F.struct(-F.floor(4 * F.log2("length")), "token"))
    homes = written(entries.groupBy("node").agg(home["token"].alias("home"), F.first("n").alias("n")), "homes")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_TOKENS)).cast("int")
    sizes = written(homes.groupBy("home").agg(F.count(F.lit(1)).alias("_n"), blocks.alias("_k")), "homes")
    dealt = attach(homes, sizes, "home", "_n", F.col("node"))
    return written(dealt.select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("_k"))).alias("block")), "blocks")


def _pairs(entries: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """`(a, b)`: pairs of blocks, a block also with itself, that hold two sets on one list whose sizes allow a link."""
    placed = attach(entries.select("node", "n", "token"), blocks.withColumn("_n", F.lit(1)), "node", "_n", F.col("token"))
    here = placed.groupBy("token", "block").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low"), F.max("n").alias("high"))
    here = written(here, "lists")
    there = here.select("token", *[F.col(c).alias(f"_{c}") for c in ("block", "low", "high")])
    both = here.join(there, "token").where("block < _block or (block = _block and k > 1)")
    fit = both.where((F.col("high") * 100 >= F.col("_low") * percent) & (F.col("_high") * 100 >= F.col("low") * percent))
    return written(fit.select(F.col("block").alias("a"), F.col("_block").alias("b")).distinct(), "pairs")


def _verified(sets: DataFrame, percent: int, schema: str) -> DataFrame:
    """What the comparison of all pairs of blocks finds: `node, low, n_links`, or all links `a, b`, by `schema`.

    A set is in one block and a pair of blocks in one task, so a pair of sets is verified once at
    most. `low` is the smallest node that a set reaches by the links of its pair of blocks.
    """
    entries = _candidates(sets)
    blocks = _blocks(sets, entries)
    pairs = _pairs(entries, blocks, percent)
    ends = F.array_distinct(F.array("a", "b"))
    of_block = written(pairs.select(F.explode(ends).alias("block"), "a", "b").groupBy("block").agg(F.collect_list(F.struct("a", "b")).alias("pairs"), F.count(F.lit(1)).alias("_n")), "pairs")
    placed = attach(sets, blocks.withColumn("_n", F.lit(1)), "node", "_n", F.col("node")).where("block is not null").drop("_n")
    meeting = attach(placed, of_block, "block", "_n", F.col("node")).where("pairs is not null")
    dealt = meeting.withColumn("pair", F.explode("pairs")).select("node", "n", "alone", "prefix", "last", "tokens", "cells", "block", "pair.a", "pair.b")
    size = of_block.join(blocks, "block").join(sets.select("node", F.size("tokens").alias("t")), "node").agg(
        F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.col("_n") * F.col("t")), F.lit(0))
    ).first()
    tasks = max(1, size[0] // TASK_ROWS, size[1] // TASK_TOKENS)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((len(names), 0), np.int64)]
        for (low, high), part in rows.groupby(["a", "b"], sort=False):
            a = _Block(part[part["block"] == low])
            b = a if low == high else _Block(part[part["block"] == high])
            linked = _links(a, b, percent, low == high)
            x, y = np.nonzero(linked)
            if names[0] == "a":
                out.append(np.array([np.minimum(a.node[x], b.node[y]), np.maximum(a.node[x], b.node[y])]))
                continue
            if low == high:
                nodes, y, counts = a.node, y, linked.sum(1) + linked.sum(0)
            else:
                nodes, y, counts = np.concatenate([a.node, b.node]), y + len(a.node), np.concatenate([linked.sum(1), linked.sum(0)])
            some = np.flatnonzero(counts)
            out.append(np.array([nodes[some], _lowest(nodes, x, y)[some], counts[some]]))
        return pd.DataFrame(dict(zip(names, np.concatenate(out, axis=1))))

    cell = F.pmod(F.xxhash64("a", "b"), F.lit(tasks)).alias("cell")
    return written(dealt.groupBy(cell).applyInPandas(lambda rows: tidied(run, rows), schema), "verified")


LINKED = "node bigint, low bigint, n_links bigint"


def _prepared(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their sets, the classes of equal sets with a number `node` each, and the sets that may link, one per class."""
    rows = written(_sets(docs, width, percent), "sets")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    some = rows.where("prefix > 0").select("key", "n", "alone", "prefix", "last", "tokens", "cells").dropDuplicates(["key"])
    return rows.select("doc_id", "content", "n", "key"), classes, written(some.join(classes.select("key", "node"), "key").drop("key"), "candidates")


def _classes(classes: DataFrame, verified: DataFrame) -> DataFrame:
    """`classes` with the smallest id that a class reaches by links, and the number of its links."""
    found = components(verified.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    per_node = verified.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    named = classes.join(found, "node", "left").join(per_node, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named, "classes")
    least = written(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("_m"), F.sum("_n").alias("rows")), "components")
    joined = attach(named, least, "component", "_m", F.col("node"))
    return joined.select("key", "_n", "component", "rows", "component_id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def _by_row(members: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of `members` with the columns of their class in `named(key, _n, ...)`; rows without words have none."""
    keyed = members.withColumn("_key", F.coalesce("key", F.concat(F.lit(b"-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))))
    return join_by_key(keyed, written(named, "named").withColumnRenamed("key", "_key"), "_key", "_n", F.col("doc_id"))


def _or_own_id(column: str) -> Column:
    return F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col(column)).alias(column)


def similar_documents(docs: DataFrame, *, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs(doc_id, text, ...)`: `doc_id, n_shingles, component_id, class_id, n_links`.

    Two documents link when 100 * common >= percent * union for their sets of n-grams of `width`
    words; `component_id` is the smallest id reachable by links. Documents with equal sets are one
    class, and its smallest id is `class_id`; `n_links` says how many other classes link with it
    (`similar_pairs` gives them).

    Exact counts of all n-grams order them rare first. Classes that share a prefix n-gram are
    compared in pairs of bounded blocks, each pair of blocks in one task that filters by length, position
    and suffix and verifies what is left, each pair of classes once; it returns numbers of links and
    what hangs together, not the pairs. So neither a list that a third of all documents are on nor their links
    come into one task, and the passes over the data are as many whatever the lists.

    A null or empty text, or one of white space, has no n-grams and links with nothing. A null id
    gets the component of a class it shares with an id or that links with one, else null. Repeated rows, and several texts
    under one id, keep a row each, with the class of its own text. Other columns are ignored.
    Hashes of 56 bits stand for n-grams: that two of a text of 20,000 words share one has a chance of 3 in 10^9.
    """
    members, classes, sets = _prepared(docs, width, percent)
    rows = _by_row(members, _classes(classes, _verified(sets, percent, LINKED)))
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), _or_own_id("component_id"), _or_own_id("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )


def similar_pairs(docs: DataFrame, *, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """All links `(a, b)`, a < b, between the classes of `similar_documents`, by the smallest ids of both.

    Of a class without any id the id is null, and comes first.
    """
    _, classes, sets = _prepared(docs, width, percent)
    links = _verified(sets, percent, "a bigint, b bigint")
    a, b = (classes.select(F.col("node").alias(side), F.col("rep").alias(f"_{side}")) for side in "ab")
    named = links.join(a, "a").join(b, "b").withColumn("_swap", F.coalesce(F.col("_a") > F.col("_b"), F.col("_b").isNull()))
    return named.select(F.when(F.col("_swap"), F.col("_b")).otherwise(F.col("_a")).alias("a"), F.when(F.col("_swap"), F.col("_a")).otherwise(F.col("_b")).alias("b"))


def drop_similar(docs: DataFrame, *, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each component: the one with the smallest id, and of several texts under it the one with the smallest hash.

    Rows are told apart by id and text, so another text under the same id is judged by itself; of rows
    that repeat both, one stays. Rows with an id come before rows without. A row without words links with
    nothing and stays. All columns are kept as they are.
    """
    members, classes, sets = _prepared(docs.select("doc_id", "text"), width, percent)
    named = _classes(classes, _verified(sets, percent, LINKED)).select("key", "_n", "component", "rows")
    placed = written(_by_row(members, named).where("rows > 1").select("doc_id", "content", "component"), "placed")
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "content")).alias("f"), F.count(F.lit(1)).alias("_m"))
    judged = attach(placed, written(first, "first"), "component", "_m", F.col("content"))
    same = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("content") == F.col("f.content"))
    verdict = judged.groupBy("doc_id", "content").agg(F.max(same).alias("stays"), F.count(F.lit(1)).alias("times"))
    verdict = written(verdict.where("not stays or times > 1"), "verdicts")
    return without(docs, verdict)


def without(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """`docs` without the rows of `verdict(doc_id, content, stays, times)` that do not stay, and with one of each that does.

    `content` is the hash of the row's text. Only rows that stay and repeat are grouped, after a partial aggregation.
    """
    names = docs.columns
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    text, doc_id = F.col("_row.text"), F.col("_row.doc_id").cast("bigint")
    rows = verdict.select(F.col("doc_id").alias("_d"), F.col("content").alias("_c"), "stays")
    joined = marked.withColumn("_h", F.xxhash64(text)).join(rows, doc_id.eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_c")), "left")
    plain = joined.where("stays is null").select("_row.*")
    once = joined.where("stays").groupBy("_d", "_h").agg(F.first("_row").alias("_row")).select("_row.*")
    return plain.unionByName(once) if verdict.where("stays").limit(1).count() else plain
