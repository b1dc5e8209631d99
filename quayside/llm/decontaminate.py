"""Benchmark decontamination: documents stream through a generalised suffix automaton of the test items."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.workspace import written

WINDOW = 10
COVERAGE = 1.0
MAX_WORDS = 200_000
MAX_HIT_SHARE = 0.5

# A word of a text whose A-Z are in lower case.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# The same by bytes: A-Z in lower case, what separates words as a space; bytes of longer characters belong to words.
_NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)

Span = tuple[int, int]


def normalised_words(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.encode().translate(_NORMAL).split()


def least_words(n: int, window: int, coverage: float) -> int:
    """Consecutive words of an item of `n` words that count as a match: `window` of them, or that share of the item if less."""
    return min(window, max(1, int(np.ceil(coverage * n))))


@dataclass
class Automaton:
    """A suffix automaton of several word sequences, with the windows of each item at their states.

    `longest` and `link` describe the states; `step[state]` leads on by word. `windows[state]` are
    the windows that belong to a state, as (words, item), shortest last; `up[state]` is the nearest
    state on the way of links, itself included, that has any. A matched run of words that ends in a
    state holds, as suffixes, the windows of the states on that way.
    """

    words: dict[bytes, int] = field(default_factory=dict)
    longest: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    windows: dict[int, list[tuple[int, str]]] = field(default_factory=dict)
    up: list[int] = field(default_factory=list)
    shortest: int = 0

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes], int]]) -> Automaton:
        """The automaton of `(item, words, window)`; each `window` consecutive words of an item are a window."""
        made = cls()
        coded = [(item, [made.words.setdefault(w, len(made.words) + 1) for w in words], window) for item, words, window in items]
        for _, codes, _ in coded:
            last = 0
            for code in codes:
                last = made._grown(last, code)
        found: dict[int, set[tuple[int, str]]] = {}
        for item, codes, window in coded:
            state = 0
            for n, code in enumerate(codes, 1):
                state = made.step[state][code]
                if n >= window:
                    at = state
                    while made.longest[made.link[at]] >= window:
                        at = made.link[at]
                    found.setdefault(at, set()).add((window, item))
        made.windows = {state: sorted(some, reverse=True) for state, some in found.items()}
        made.shortest = min((w for some in made.windows.values() for w, _ in some), default=0)
        made.up = [-1] * len(made.link)
        for state in sorted(range(1, len(made.link)), key=made.longest.__getitem__):
            made.up[state] = state if state in made.windows else made.up[made.link[state]]
        return made

    def _new(self, longest: int, link: int, step: dict[int, int]) -> int:
        self.longest.append(longest)
        self.link.append(link)
        self.step.append(step)
        return len(self.link) - 1

    def _split(self, before: int, code: int) -> int:
        """The state that `code` leads to from `before`, made to end with that step as its longest."""
        there = self.step[before][code]
        if self.longest[there] == self.longest[before] + 1:
            return there
        copy = self._new(self.longest[before] + 1, self.link[there], dict(self.step[there]))
        self.link[there] = copy
        while before >= 0 and self.step[before].get(code) == there:
            self.step[before][code] = copy
            before = self.link[before]
        return copy

    def _grown(self, last: int, code: int) -> int:
        """Add a word after the sequence that ends in `last`; the state of the longer sequence."""
        if code in self.step[last]:
            return self._split(last, code)
        new = self._new(self.longest[last] + 1, 0, {})
        at = last
        while at >= 0 and code not in self.step[at]:
            self.step[at][code] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, code)
        return new

    def matched(self, state: int, length: int) -> tuple[int, frozenset[str]]:
        """The longest window that is a suffix of the last `length` words, which lead to `state`, and the items of all."""
        most, items = 0, set()
        at = self.up[state]
        while at > 0:
            for words, item in self.windows[at]:
                if words <= length:
                    most = max(most, words)
                    items.add(item)
            at = self.up[self.link[at]]
        return most, frozenset(items)

    def search(self, codes: np.ndarray, known: dict) -> tuple[list[Span], set[str]]:
        """Runs of words inside windows, and the items of these windows. `known` keeps answers of `matched`.

        Words outside the vocabulary end every match, so only runs of words inside it that are long
        enough for the shortest window are walked.
        """
        spans: list[Span] = []
        items: set[str] = set()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], codes > 0, [0]])))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        step, link, longest, up = self.step, self.link, self.longest, self.up
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            state = length = 0
            for n, code in enumerate(codes[start:end].tolist(), start + 1):
                while state and code not in step[state]:
                    state = link[state]
                    length = longest[state]
                state = step[state].get(code, 0)
                length = length + 1 if state else 0
                if length >= self.shortest and up[state] > 0:
                    key = (state, length)
                    if key not in known:
                        known[key] = self.matched(state, length)
                    most, some = known[key]
                    if most:
                        items |= some
                        if spans and spans[-1][1] >= n - most:
                            first = spans[-1][0]
                            while spans and spans[-1][1] >= n - most:
                                first = min(first, spans.pop()[0])
                            spans.append((min(first, n - most), n))
                        else:
                            spans.append((n - most, n))
        return spans, items


def merged(spans: list[Span]) -> list[Span]:
    """Disjoint runs in order that cover the same words."""
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(first, end) for first, end in out]


def pieces(items: DataFrame, window: int, coverage: float, max_words: int) -> DataFrame:
    """`(item string, words binary, n, window, n_words)` of `items(item_id, text, ...)`: the words in pieces.

    An item of more than `max_words` words is cut into pieces that overlap by a window less one
    word, so each of its windows is in exactly one. Items without words have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = normalised_words(text.as_py() or "")
                least = least_words(len(words), window, coverage)
                for start in range(0, max(1, len(words) - least + 1) if words else 0, max_words):
                    part = words[start : start + max_words + least - 1]
                    rows.append((item, b" ".join(part), least, len(part)))
            if rows:
                types = [pa.string(), pa.binary(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["item", "words", "window", "n"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.mapInArrow(run, "item string, words binary, window int, n int")


def automata(items: DataFrame, *, window: int = WINDOW, coverage: float = COVERAGE, max_words: int = MAX_WORDS) -> DataFrame:
    """`(shard, automaton binary)`: automata of about `max_words` words at most, all items being in one of them.

    Each is built by one task from its share of the pieces, in compressed form a few megabytes.
    """
    cut = written(pieces(items, window, coverage, max_words).dropDuplicates(), "items")
    total = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // max_words))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "words"])
        made = Automaton.of([(item, bytes(words).split(), window) for item, words, window in zip(rows["item"], rows["words"], rows["window"])])
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "automaton": [zlib.compress(pickle.dumps(made), 1)]})

    shard = F.pmod(F.xxhash64("item", "words"), F.lit(shards)).alias("shard")
    return written(cut.select(shard, "item", "words", "window").groupBy("shard").applyInPandas(build, "shard bigint, automaton binary"), "automata")


MAX_ANSWERS = 1_000_000

_loaded: list = []


def _loaded_automaton(packed: Broadcast) -> tuple[Automaton, dict]:
    """The automaton of a broadcast, unpacked once by a Python worker, and the answers it has given so far."""
    if not _loaded or _loaded[0] is not packed:
        _loaded[:] = [packed, pickle.loads(zlib.decompress(packed.value)), {}]
    if len(_loaded[2]) > MAX_ANSWERS:
        _loaded[2] = {}
    return _loaded[1], _loaded[2]


SPANS = "array<struct<first: int, end: int>>"
FOUND = f"n_words bigint, spans {SPANS}, items array<string>"


def _searched(docs: DataFrame, packed: Broadcast) -> DataFrame:
    """`docs` (the first column, then `text`) with FOUND in place of the text."""
    first, schema = docs.columns[0], f"{docs.columns[0]} bigint, {FOUND}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _loaded_automaton(packed)
        code = automaton.words.get
        spans_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            sizes, spans, items = [], [], []
            for text in batch.column(1):
                words = normalised_words(text.as_py() or "")
                sizes.append(len(words))
                some, names = automaton.search(np.fromiter(map(code, words, repeat(0)), np.int64, len(words)), known)
                spans.append([{"first": a, "end": b} for a, b in some])
                items.append(sorted(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))],
                names=[first, "n_words", "spans", "items"],
            )

    return docs.mapInArrow(run, schema)


def _found(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """`docs(doc_id, text)` with FOUND, after a search by all automata."""
    spark = docs.sparkSession
    # One automaton at a time is in the driver, each of a bounded size.
    packed = [spark.sparkContext.broadcast(bytes(row["automaton"])) for row in parts.select("automaton").toLocalIterator()]
    if not packed:
        packed = [spark.sparkContext.broadcast(zlib.compress(pickle.dumps(Automaton.of([]))))]
    if len(packed) == 1:
        return _searched(docs, packed[0])
    # Rows are told apart by their place in a table that is written once and read by every search.
    rows = written(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), "placed")
    searches = [written(_searched(rows.select("_row", "text"), one).where("size(spans) > 0"), "found") for one in packed]
    hits = searches[0]
    for other in searches[1:]:
        hits = hits.unionByName(other)
    sizes = _searched(rows.select("_row", "text"), spark.sparkContext.broadcast(zlib.compress(pickle.dumps(Automaton.of([])))))
    together = hits.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = rows.select("_row", "doc_id").join(sizes.select("_row", "n_words"), "_row").join(together, "_row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"first": a, "end": b} for a, b in merged([(s["first"], s["end"]) for s in some or []])] for some in batch.column(2).to_pylist()]
            items = [sorted(some or []) for some in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "n_words", "spans", "items"],
            )

    return joined.select("doc_id", "n_words", "spans", "items").mapInArrow(run, f"doc_id bigint, {FOUND}")


def contamination(
    docs: DataFrame, items: DataFrame, *, window: int = WINDOW, coverage: float = COVERAGE, max_words: int = MAX_WORDS
) -> DataFrame:
    """One row per row of `docs(doc_id, text, ...)`: `doc_id, n_words, n_hit, n_items, items, spans, contaminated`.

    A window of an item of `items(item_id, text, ...)` is any `window` consecutive words of it, or
    fewer where they are the share `coverage` of a shorter item. All items are in suffix automata of
    at most about `max_words` words, which are broadcast; usually that is one. Each document is
    streamed through: the automaton keeps the longest run of words so far that some item holds, and
    where that reaches a window, the words of the window are hit. `spans` are the runs of hit words,
    as the number of their first word and the one after their last; `items` the item_ids, as
    sorted texts, that have a window there.

    With one automaton nothing is shuffled. More are searched one after the other over the whole
    table, and what they find is put together by row.

    A null or empty text, of documents or items, has no words; an item without words has no window. An item
    without an id counts under the empty text, and several items under one id count as one. Repeated rows of
    `docs` keep one row each. Other columns are ignored; without items nothing is hit.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = _found(rows, automata(items, window=window, coverage=coverage, max_words=max_words))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated")
    )


def items_digest(items: Column) -> Column:
    """SHA-256 of the item_ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)


def without_spans(text: str, spans: list[Span]) -> str:
    """`text` without the words of `spans` and what lies between them; what stands around a span is kept, apart by a space."""
    words = list(WORD.finditer(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))
    kept, at = [], 0
    for first, end in spans:
        before = text[at : words[first].start()].rstrip()
        kept.append(before.lstrip() if at else before)
        at = words[end - 1].end()
    return " ".join(part for part in [*kept, text[at:].lstrip() if at else text] if part)


def decontaminate(
    docs: DataFrame, items: DataFrame, *, window: int = WINDOW, coverage: float = COVERAGE, max_hit_share: float = MAX_HIT_SHARE, max_words: int = MAX_WORDS
) -> DataFrame:
    """`docs` without the contaminated spans, and without documents of which they are more than `max_hit_share` of the words.

    Only a document with hits is changed: its `text` loses the hit words. The automata have to fit
    one by one, as in `contamination`; more than one are applied one after the other, each to what
    the one before has left, so a span of any item goes. All columns and clean rows are kept as they are.
    """
    spark, out = docs.sparkSession, docs
    parts = automata(items, window=window, coverage=coverage, max_words=max_words)
    for row in parts.select("automaton").toLocalIterator():
        packed = spark.sparkContext.broadcast(bytes(row["automaton"]))
        out = _cleaned(out, packed, max_hit_share)
    return out


def _cleaned(docs: DataFrame, packed: Broadcast, max_hit_share: float) -> DataFrame:
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _loaded_automaton(packed)
        code = automaton.words.get
        for batch in batches:
            keep, texts = [], []
            for text in batch.column(at).to_pylist():
                words = normalised_words(text or "")
                spans, _ = automaton.search(np.fromiter(map(code, words, repeat(0)), np.int64, len(words)), known)
                keep.append(sum(b - a for a, b in spans) <= max_hit_share * len(words))
                texts.append(without_spans(text, spans) if spans and keep[-1] else text)
            columns = [pa.array(texts, pa.string()) if k == at else column for k, column in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in columns], names=names)

    return docs.mapInArrow(run, docs.schema)
