"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm._shards import cuts, group_bytes, grouped_texts, ids_of, of_groups, shard_bits, summed, ungrouped, words_in
from quayside.llm._words import chunks, hashed_words, mixed, packed, unpacked
from quayside.workspace import new_path

ADD = 0.1
ORDER = 2
MU = 2000.0
BITS_PER_ENTRY = 10
PROBES = 4
MIN_REGION_BITS = 10
GRAM_BYTES = 5
BROADCAST_BYTES = 16 << 20

#: Stand for the end of a text and the place before its first word; no word has these hashes but by chance.
END = np.uint64(0x9E3779B97F4A7C15)
START = np.uint64(0xC2B2AE3D27D4EB4F)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-case words of each text and then of its end, one text after the other, and their numbers.

    Hashes stand for words throughout: among a billion distinct words the chance that any two share one is 3 in 100.
    """
    words, counts = hashed_words(texts)
    ends = np.cumsum(counts) + np.arange(len(counts))
    tokens = np.empty(len(words) + len(counts), np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[ends] = True
    tokens[is_end], tokens[~is_end] = END, words
    return tokens, counts + 1


def gram_keys(tokens: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams of two to `order` tokens that end at each token, one array per length."""
    first = np.cumsum(lengths) - lengths
    keys, made, before = mixed(tokens), [], tokens
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            before = np.concatenate([[START], before[:-1]])
            before[first] = START
            keys = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + before + np.uint64(n))
            made.append(keys)
    return made


def level_of(counts: np.ndarray) -> np.ndarray:
    """Quantised logarithm: 1 for 1, 2 for 2 to 3, 3 for 4 to 7, ..."""
    return np.floor(np.log2(counts)).astype(np.int64) + 1


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level; 0 for level 0."""
    return np.where(levels > 0, 1.5 * 2.0 ** (levels - 1) - 0.5, 0.0)


def _place(keys: np.ndarray, level: int, probe: int, region_bits: int) -> np.ndarray:
    """Bit numbers of the entries (key, level) for one of the probes."""
    with np.errstate(over="ignore"):
        return mixed(keys + np.uint64(level * PROBES + probe) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - region_bits)


@dataclass
class LogFrequencyFilter:
    """A Bloom filter that holds (n-gram, j) for all j up to the level of the n-gram's count."""

    bits: np.ndarray
    region_bits: int

    @classmethod
    def holding(cls, keys: np.ndarray, counts: np.ndarray) -> LogFrequencyFilter:
        """A filter of all the n-grams: it has BITS_PER_ENTRY bits or more for each of their entries."""
        levels = level_of(counts)
        region_bits = MIN_REGION_BITS
        while 1 << region_bits < int(levels.sum()) * BITS_PER_ENTRY:
            region_bits += 1
        bits = np.zeros(1 << (region_bits - 3), np.uint8)
        for level in range(1, int(levels.max(initial=0)) + 1):
            some = keys[levels >= level]
            for probe in range(PROBES):
                place = _place(some, level, probe, region_bits)
                np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        return cls(bits, region_bits)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of n-grams: membership is probed for 1, 2, ... until it fails."""
        found = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        level = 1
        while len(left):
            for place in range(PROBES):
                at = _place(keys[left], level, place, self.region_bits)
                there = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                left = left[there == 1]
            found[left] = level
            level += 1
            if level > 60:
                break
        return found


@dataclass
class _Region:
    """The part of a model for one shard: exact counts of its words and the filter of its n-grams."""

    words: np.ndarray
    counts: np.ndarray
    grams: LogFrequencyFilter

    @classmethod
    def of(cls, row: pd.Series | dict) -> _Region:
        bits = LogFrequencyFilter(np.frombuffer(bytes(row["filter"]), np.uint8), int(row["filter_bits"]))
        return cls(np.frombuffer(bytes(row["words"]), np.uint64), np.frombuffer(bytes(row["counts"]), np.int64), bits)

    def word_counts(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)


REGION = "shard int, n_tokens bigint, vocabulary bigint, words binary, counts binary, filter_bits int, filter binary"
ABOUT = "bits int, n_order int, n_texts bigint, n_tokens bigint, vocabulary bigint, bytes bigint"


@dataclass
class LanguageModel:
    """A model that lies in a folder: its regions, one for each shard of the key space, and what they amount to."""

    path: str
    bits: int
    order: int
    n_texts: int
    n_tokens: int
    vocabulary: int
    bytes: int

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LanguageModel:
        """A model that `fit` has written to `path`."""
        return cls(path, *spark.read.schema(ABOUT).parquet(f"{path}/about").first())

    def regions(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(REGION).parquet(f"{self.path}/regions")


def _gram_part(keys: np.ndarray, bits: int) -> np.ndarray:
    """The part of n-gram keys that is used: the `bits` that pick the shard and GRAM_BYTES bytes more."""
    return keys >> np.uint64(max(0, 64 - 8 * GRAM_BYTES - bits))


def _asked(texts: list[bytes], order: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and n-grams of the texts, all of them, and the numbers of tokens: `words, grams, lengths`, n-grams length by length."""
    tokens, lengths = tokens_of(texts)
    grams = gram_keys(tokens, lengths, order)
    return tokens, _gram_part(np.concatenate([np.zeros(0, np.uint64), *grams]), bits), lengths


def _parts(words: np.ndarray, grams: np.ndarray, bits: int) -> Iterator[tuple[int, slice, slice]]:
    """The shards and where their words and n-grams are among sorted ones."""
    at = cuts(words, bits, 64), cuts(grams, bits, min(64, 8 * GRAM_BYTES + bits))
    for shard in range(1 << bits):
        some = [slice(edges[shard], edges[shard + 1]) for edges in at]
        if any(s.start < s.stop for s in some):
            yield shard, *some


def _sparse(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as the places of those above 1, and these."""
    many = np.flatnonzero(counts > 1)
    return many.astype(np.uint32).tobytes(), counts[many].astype(np.int64).tobytes()


def _dense(n: int, many: bytes, times: bytes) -> np.ndarray:
    counts = np.ones(n, np.int64)
    counts[np.frombuffer(many, np.uint32)] = np.frombuffer(times, np.int64)
    return counts


def fit(texts: DataFrame, *, order: int = ORDER, path: str | None = None) -> LanguageModel:
    """Count all words and n-grams of all `texts(text)`, and write the model to `path`, by default in the shared folder.

    Tasks count the distinct words and n-grams of a group of texts and send them to the shards of the key space,
    so none is hot however often it occurs. The task of a shard sums them and writes its region:
    exact counts of words, and a log-frequency Bloom filter of all n-grams of 2 to `order` words, with their counts
    quantised. The filter grows with the distinct n-grams, and no n-gram is left out. A null text is empty.
    """
    spark = texts.sparkSession
    keys = words_in(texts) * order
    bits, size = shard_bits(keys), group_bytes(keys)
    names = ["shard", "words", "word_many", "word_times", "grams", "gram_many", "gram_times", "n_texts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((x.as_py() or b"") for batch in batches for x in batch.column(0))
        for held in chunks(texts, size):
            words, grams, _ = _asked(held, order, bits)
            words, word_counts = np.unique(words, return_counts=True)
            grams, gram_counts = np.unique(grams, return_counts=True)
            rows = [
                (shard, words[w].tobytes(), *_sparse(word_counts[w]), packed(grams[g], GRAM_BYTES), *_sparse(gram_counts[g]), 0)
                for shard, w, g in _parts(words, grams, bits)
            ]
            rows[0] = (*rows[0][:-1], len(held))
            types = [pa.int32(), *[pa.binary()] * 6, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    def region(block: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(x, np.uint64) for x in block["words"]]
        words, counts, _ = summed(words, [_dense(len(x), *y) for x, y in zip(words, zip(block["word_many"], block["word_times"]))])
        shard = int(block["shard"].iloc[0])
        grams = [unpacked(x, GRAM_BYTES) + (np.uint64(shard) << np.uint64(8 * GRAM_BYTES)) for x in block["grams"]]
        grams, times, _ = summed(grams, [_dense(len(x), *y) for x, y in zip(grams, zip(block["gram_many"], block["gram_times"]))])
        made = LogFrequencyFilter.holding(grams, times)
        row = {
            "shard": shard, "n_texts": int(block["n_texts"].sum()), "n_tokens": int(counts.sum()), "vocabulary": len(words),
            "words": words.tobytes(), "counts": counts.tobytes(), "filter_bits": made.region_bits, "filter": made.bits.tobytes(),
        }
        return pd.DataFrame([row])

    kinds = ["int", *["binary"] * 6, "bigint"]
    blocks = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, ", ".join(map(" ".join, zip(names, kinds))))
    path = path or new_path(spark, "model")
    blocks.groupBy("shard").applyInPandas(region, f"n_texts bigint, {REGION}").write.parquet(f"{path}/regions")
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("n_texts", "n_tokens", "vocabulary")]
    held = F.octet_length("words") + F.octet_length("counts") + F.octet_length("filter")
    found = spark.read.schema(f"n_texts bigint, {REGION}").parquet(f"{path}/regions").agg(*sums, F.coalesce(F.sum(held), F.lit(0))).first()
    about = LanguageModel(path, bits, order, *found)
    row = [(about.bits, about.order, about.n_texts, about.n_tokens, about.vocabulary, about.bytes)]
    spark.createDataFrame(row, ABOUT).coalesce(1).write.parquet(f"{path}/about")
    return about


SCORED = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _scored(model: LanguageModel, lengths: np.ndarray, counts: np.ndarray, levels: np.ndarray) -> dict[str, np.ndarray]:
    """The scores of texts from the counts of their tokens and the levels of their n-grams, length by length."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    count = counts.astype(np.float64)
    p = (count + ADD) / (model.n_tokens + ADD * (model.vocabulary + 1))
    base, known = np.log10(p), count > 0
    starts = np.cumsum(lengths) - lengths
    for n in range(model.order - 1):
        history = np.concatenate([[0.0], count[:-1]])  # the count of what ends one token earlier
        history[starts] = model.n_texts
        count = count_of(levels[n * len(row) : (n + 1) * len(row)].astype(np.int64))
        p = (count + MU * p) / (np.maximum(history, count) + MU)
    return {
        "n_tokens": lengths, "n_known": np.bincount(row, known, len(lengths)).astype(np.int64),
        "base_score": np.bincount(row, base, len(lengths)), "score": np.bincount(row, np.log10(np.minimum(p, 1.0)), len(lengths)),
    }


def score_with(docs: DataFrame, model: LanguageModel, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of `docs(doc_id, text, ...)`: SCORED, by a model of whatever texts.

    `score` is the log10 probability of the text under an n-gram model with Dirichlet smoothing,
    P(w|h) = (c(hw) + MU P'(w|h')) / (c(h) + MU), down to (c(w) + 0.1) / (N + 0.1 (V + 1)). Counts of
    single words are exact; those of longer n-grams come out of probes of the filter, and nothing else of
    them is known.

    A model of at most `broadcast_bytes` goes to all workers, and each text is scored where it is read. The
    regions of a larger one stay where they are: groups of texts send their distinct words and n-grams to the
    shards, whose regions are probed there, and texts meet the answers by a shuffle. The same regions answer, so both give the
    same scores. A null text is empty and has the end alone; repeated rows and null ids keep one row each. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if model.bytes <= broadcast_bytes:
        return _scored_by_broadcast(rows, model, model.regions(spark))
    return _scored_by_shuffle(rows, model, model.regions(spark))


def _scored_by_broadcast(rows: DataFrame, model: LanguageModel, regions: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast([row.asDict() for row in regions.collect()])  # checked against broadcast_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {row["shard"]: _Region.of(row) for row in held.value}
        for batch in batches:
            at, out = 0, []
            for texts in chunks((x.as_py() or "").encode() for x in batch.column(1)):
                words, grams, lengths = _asked(texts, model.order, model.bits)
                some, word_at = np.unique(words, return_inverse=True)
                keys, gram_at = np.unique(grams, return_inverse=True)
                counts, levels = np.zeros(len(some), np.int64), np.zeros(len(keys), np.uint8)
                for shard, w, g in _parts(some, keys, model.bits):
                    if shard in parts:
                        counts[w], levels[g] = parts[shard].word_counts(some[w]), parts[shard].grams.levels(keys[g])
                found = _scored(model, lengths, counts[word_at], levels[gram_at])
                out.append(pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *map(pa.array, found.values())], names=["doc_id", *found]))
                at += len(texts)
            yield from out

    return rows.mapInArrow(run, SCORED)


def _scored_by_shuffle(rows: DataFrame, model: LanguageModel, regions: DataFrame) -> DataFrame:
    groups = grouped_texts(rows, group_bytes(words_in(rows) * model.order))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, _, texts in of_groups(batches):
            words, grams, _ = _asked(texts, model.order, model.bits)
            words, grams = np.unique(words), np.unique(grams)
            out = [(shard, grp, words[w].tobytes(), packed(grams[g], GRAM_BYTES)) for shard, w, g in _parts(words, grams, model.bits)]
            types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["shard", "grp", "words", "grams"])

    def answer(asked: pd.DataFrame, region: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(x, np.uint64) for x in asked["words"]]
        grams = [unpacked(x, GRAM_BYTES) for x in asked["grams"]]
        # All groups ask at once, and what several ask for is probed once.
        some, word_at = np.unique(np.concatenate(words), return_inverse=True)
        keys, gram_at = np.unique(np.concatenate(grams), return_inverse=True)
        counts, levels = np.zeros(len(some), np.int64), np.zeros(len(keys), np.uint8)
        if len(region):
            own, shard = _Region.of(region.iloc[0]), np.uint64(int(region["shard"].iloc[0]) << 8 * GRAM_BYTES)
            counts, levels = own.word_counts(some), own.grams.levels(keys + shard).astype(np.uint8)
        counts = np.split(counts[word_at], np.cumsum([len(w) for w in words])[:-1])
        levels = np.split(levels[gram_at], np.cumsum([len(g) for g in grams])[:-1])
        # Most counts are small; the others are sent with their places.
        small = [np.minimum(c, 255).astype(np.uint8).tobytes() for c in counts]
        large = [c[c >= 255].tobytes() for c in counts]
        return pd.DataFrame({"grp": asked["grp"], "shard": asked["shard"], "small": small, "large": large, "levels": [x.tobytes() for x in levels]})

    def settle(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        meta, texts = ungrouped(group["meta"].iloc[0], group["texts"].iloc[0])
        words, grams, lengths = _asked(texts, model.order, model.bits)
        answers = answers.sort_values("shard")
        counts = np.frombuffer(b"".join(answers["small"]), np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(b"".join(answers["large"]), np.int64)
        levels = np.frombuffer(b"".join(answers["levels"]), np.uint8)
        word_at, gram_at = np.unique(words, return_inverse=True)[1], np.unique(grams, return_inverse=True)[1]
        return pd.DataFrame({"doc_id": ids_of(meta, "doc_id"), **_scored(model, lengths, counts[word_at], levels[gram_at])})

    asked = groups.mapInArrow(ask, "shard int, grp bigint, words binary, grams binary")
    answers = asked.groupBy("shard").cogroup(regions.groupBy("shard")).applyInPandas(answer, "grp bigint, shard int, small binary, large binary, levels binary")
    return groups.groupBy("grp").cogroup(answers.groupBy("grp")).applyInPandas(settle, SCORED)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of ten; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def score(docs: DataFrame, *, training: Callable[[Column], Column] = lambda doc_id: ~held_out(doc_id), order: int = ORDER, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of `docs(doc_id, text, ...)`: `doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`.

    A model is fitted to the rows that `training` picks (`fit`) and scores all (`score_with`).
    `base_score` is that of single words alone. With no training rows the counts are all zero.
    """
    model = fit(docs.where(F.coalesce(training(F.col("doc_id")), F.lit(False))).select("text"), order=order)
    found = score_with(docs, model, broadcast_bytes=broadcast_bytes)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
