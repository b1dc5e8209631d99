"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm._memory import tidied_batches

BUCKET_BITS = 17
DIMENSIONS = 4
SHORTEST, LONGEST = 3, 6
PRIOR_WORDS = 15
MAX_TRAIN = (5000, 2000)  # clean, toxic
MAX_TRAIN_CHARS = 20_000
STEPS = 1000
BATCH = 64
RATE = 0.5
GAIN = 20.0
DECAY = 1e-6
MIN_DOCS, MIN_DOC_SHARE = 3, 1 / 600
TOXIC_FROM = 0.7
PART_CHARS = 1_000_000

# True for the code points below 128 that are part of words.
ASCII_WORD = np.array([chr(c).isalnum() for c in range(128)])


def _in_word(points: np.ndarray) -> np.ndarray:
    """Letters and digits; beyond Latin-1 signs and the blocks of punctuation all counts as letters."""
    other = (points >= 0xC0) & ~((points >= 0x2000) & (points < 0x2C00)) & ~((points >= 0x3000) & (points < 0x3040)) & (points != 0xFEFF)
    return np.where(points < 128, ASCII_WORD[np.minimum(points, 127)], other)


def _parts(text: str) -> Iterator[str]:
    """Long texts in parts that end at white space, so that memory is bounded; where there is none a part is longer."""
    start = 0
    while len(text) - start > PART_CHARS:
        m = re.compile(r"\s").search(text, start + PART_CHARS)
        if not m:
            break
        yield text[start : m.end()]
        start = m.end()
    yield text[start:]


def subwords(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of all character n-grams inside words, the word that each belongs to, and the number of words.

    A word is a run of letters and digits of the lower-case text; the place before and the place
    after it belong to its n-grams, so beginnings and ends differ from inner parts.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    inside = _in_word(points)
    points = np.where(inside, points, 32).astype(np.uint32)
    word = np.cumsum(inside & ~np.concatenate([[False], inside[:-1]])) - 1
    n_words = int(word[-1]) + 1
    places = np.arange(len(points))
    ends = np.where(inside, len(points), places)
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    ends = np.concatenate([ends[1:], [len(points)]])  # the first place after this one outside of words
    hashes, buckets, words = points.copy(), [], []
    for n in range(2, LONGEST + 1):
        hashes = hashes[:-1] * np.uint32(0x01000193) ^ points[n - 1 :]
        if n >= SHORTEST:
            at = np.flatnonzero(ends[: len(hashes)] >= places[: len(hashes)] + n - 1)
            buckets.append((hashes[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS))
            words.append(word[at + 1])
    if not n_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    return np.concatenate(buckets).astype(np.int64), np.concatenate(words), n_words


def _row(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A document as a sparse row of buckets and weights. A document is the mean of its words, a word
    the mean of its subwords; PRIOR_WORDS empty words keep the mean of a few words small."""
    buckets, words, n = subwords(text)
    share = 1.0 / (np.bincount(words, minlength=n)[words] * (n + PRIOR_WORDS))
    unique, back = np.unique(buckets, return_inverse=True)
    return unique.astype(np.int32), np.bincount(back, share, len(unique)).astype(np.float32)


class _Rows:
    """The rows of all texts one after the other in two arrays, with the buckets in at least `least` documents only.

    Rows are made twice, so that the rare buckets are never held.
    """

    def __init__(self, texts: list[str], least: float) -> None:
        docs, most = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for text in texts:
            cols = _row(text)[0]
            docs[cols] += 1
            most += len(cols)
        self.known = docs >= least
        # Pages that are never written take no memory.
        self.cols, self.weights, self.starts = np.empty(most, np.int32), np.empty(most, np.float32), [0]
        for text in texts:
            cols, weights = _row(text)
            keep = self.known[cols]
            at, end = self.starts[-1], self.starts[-1] + int(keep.sum())
            self.cols[at:end], self.weights[at:end] = cols[keep], weights[keep] * np.float32(GAIN)
            self.starts.append(end)

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number in `docs`, bucket and weight of each entry of these documents."""
        parts = [slice(self.starts[d], self.starts[d + 1]) for d in docs]
        row = np.repeat(np.arange(len(docs)), [p.stop - p.start for p in parts])
        return row, np.concatenate([self.cols[p] for p in parts]), np.concatenate([self.weights[p] for p in parts])


class Model:
    """`values` is the toxic minus the clean logit of each bucket, `bias` that of no words at all."""

    def __init__(self, values: np.ndarray, bias: float) -> None:
        self.values, self.bias = values, bias

    def score(self, text: str) -> float:
        """Probability of the toxic class: the softmax of the mean over all words."""
        total, count = 0.0, 0
        for part in _parts(text):
            buckets, words, n = subwords(part)
            if n:
                grams = np.bincount(words, minlength=n)
                total += float((np.bincount(words, self.values[buckets], n) / np.maximum(grams, 1)).sum())
                count += n
        return float(1 / (1 + np.exp(-np.clip(self.bias + total / (count + PRIOR_WORDS), -60, 60))))


def train(texts: list[str], labels: list[int], seed: int = 0) -> Model:
    """Embeddings of subwords and the softmax over their document mean, trained together.

    Adagrad over about STEPS mini-batches; buckets in fewer than MIN_DOCS documents, or a
    smaller share than MIN_DOC_SHARE, keep a zero vector, so words
    of one document teach nothing. Without examples of both classes, the score is 0 or 1 for all.
    """
    y = np.array(labels, np.int64)
    size = 1 << BUCKET_BITS
    if len(set(labels)) < 2:
        return Model(np.zeros(size, np.float32), 60.0 if labels and labels[0] else -60.0)
    rows = _Rows(texts, max(MIN_DOCS, MIN_DOC_SHARE * len(y)))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32) * rows.known[:, None]
    out = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    emb_sq, out_sq, bias_sq = np.full((size, DIMENSIONS), 1e-6, np.float32), np.full_like(out, 1e-2), np.full_like(bias, 1e-2)
    epochs = max(1, -(-STEPS * BATCH // len(y)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            docs = order[k : k + BATCH]
            row, c, w = rows.of(docs)
            mean = np.stack([np.bincount(row, w * emb[c, d], len(docs)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), y[docs]] -= 1
            p /= np.float32(len(docs))
            g_out, g_bias, g_mean = mean.T @ p, p.sum(0), p @ out.T
            touched, back = np.unique(c, return_inverse=True)
            g_emb = np.stack([np.bincount(back, w * g_mean[row, d], len(touched)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            g_emb += DECAY * emb[touched]
            for x, g, sq, pick in ((emb, g_emb, emb_sq, touched), (out, g_out, out_sq, slice(None)), (bias, g_bias, bias_sq, slice(None))):
                sq[pick] += g * g
                x[pick] -= rate * g / np.sqrt(sq[pick])
    values = (emb @ (out[:, 1] - out[:, 0]) * GAIN).astype(np.float32)
    return Model(values, float(bias[1] - bias[0]))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id has none."""
    return F.crc32(doc_id.cast("string")) % by


def fit(docs: DataFrame, labels: DataFrame, *, max_train: tuple[int, int] = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """Train on a bounded sample of the labelled rows that are not held out.

    At most `max_train` ids of each class (clean, toxic), those with the smallest hashes of their ids, and
    of these documents those of at most `max_chars` characters; so what comes to the driver is
    bounded whatever the tables hold. Only ids are sorted, and only the sample's texts are gathered.
    """
    usable = labels.where(remainder(F.col("doc_id"), 3) != 1).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for label in (0, 1):
        some = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train[label])
        ids = some if ids is None else ids.unionByName(some)
    chosen = ids.select(F.col("doc_id").alias("_id"), "toxic")  # at most sum(max_train) rows
    sample = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .where(F.length("text") <= max_chars)
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    sample.sort(key=lambda row: row["doc_id"])
    return train([row["text"] for row in sample], [row["toxic"] for row in sample])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs(doc_id, text, ...)`: `doc_id, held_out, score, predicted`.

    The score reads the whole text and nothing else. The model has a fixed size (2^BUCKET_BITS
    numbers) and goes to the workers as a broadcast; each row is scored where it is read. A null
    text counts as empty and gets the score of no words. A null id is not held out. Repeated rows
    get the same score; of repeated labels the larger counts; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.score(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows that `score` calls toxic; each row is judged by its own text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [model.value.score(text.as_py() or "") < TOXIC_FROM for text in batch.column(at)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(clean, pa.bool_())) for c in batch.columns], names=names)

    return docs.mapInArrow(tidied_batches(run), docs.schema)
