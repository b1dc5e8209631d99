"""Packing by power-of-two decomposition: every sequence is one binary-length piece of one document."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._memory import tidied_batches
from quayside.llm._shared import numbered
from quayside.workspace import written

MAX_TOKENS = 2048
END_ID = 1
PART_CHARS = 1_000_000
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def binary_lengths(n: int, longest: int) -> list[int]:
    """`n` as a sum of powers of two, largest first, none above `longest` (itself a power of two)."""
    lengths = [longest] * (n // longest)
    rest = n % longest
    return lengths + [1 << bit for bit in range(longest.bit_length() - 2, -1, -1) if rest >> bit & 1]


def safe_parts(text: str) -> Iterator[str]:
    """A text cut so that the tokens of the parts, one after the other, are the tokens of the whole.

    The tokenizer starts a new word at a single space between two other characters, so no token
    reaches over such a place. Only texts over PART_CHARS are cut, to bound the memory; where there
    is no such place a part is longer.
    """
    start = 0
    while len(text) - start > PART_CHARS and (cut := SAFE_CUT.search(text, start + PART_CHARS)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class TextEncoder:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    The ids are those of the `tokenizers` library and its vocabulary file; the tests hold them
    against it. The twin of that file with the same ids as ranks is read here, because on words of
    invented languages that library takes four times as long.
    """

    def __init__(self, ranks: str, pattern: str) -> None:
        import tiktoken

        with open(ranks, "rb") as lines:
            mergeable = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=mergeable, special_tokens={})

    def encoded(self, text: str) -> bytes:
        parts = [self.encoding.encode_to_numpy(part, disallowed_special=()) for part in safe_parts(text)]
        return b"".join([part.astype("<u4", copy=False).tobytes() for part in parts])


_encoders: dict[tuple[str, str], TextEncoder] = {}


def encoder(ranks: str, pattern: str) -> TextEncoder:
    """One encoder for each vocabulary and Python worker."""
    if (ranks, pattern) not in _encoders:
        _encoders[ranks, pattern] = TextEncoder(ranks, pattern)
    return _encoders[ranks, pattern]


def pack(docs: DataFrame, ranks: str, pattern: str, *, longest: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of `docs(doc_id, text, ...)`: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, bucket`.

    A document's ids (those of its text, then `end_id`) are split into pieces whose lengths are
    powers of two, at most `longest`. Each piece is a sequence of its own, so `offset` is 0, no
    sequence crosses documents and none holds padding. `bucket` is the common length of its
    sequences; sequence numbers run through one bucket after the other, gapless from 0.

    Texts are tokenised where they are read, one after the other; only narrow
    rows are then sorted into buckets, by ranges that also hold the document id, so that a bucket
    with a third of all rows is split. A null text is empty and so has the end id alone. Repeated
    rows, also with a null id, are packed each for itself. Other columns are ignored. `ranks`
    is the path of the vocabulary file, the same on every machine; `pattern` is its word pattern.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest has to be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(ranks, pattern)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = (tok.encoded(text.as_py()) if text.is_valid else b"") + end
                tokens, start = len(ids) // 4, 0
                for length in binary_lengths(tokens, longest):
                    found.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), tokens))
                    start += length
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=PIECE_COLUMNS)

    pieces = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        tidied_batches(run), ", ".join(f"{c} bigint" for c in PIECE_COLUMNS)
    )
    # Written first, because finding the ranges reads the pieces once more.
    in_buckets = numbered(written(pieces, "cut"), ["length", "doc_id", "start", "ids_crc32"], "sequence_id", "pieces")
    return in_buckets.withColumn("offset", F.lit(0).cast("bigint")).withColumn("bucket", F.col("length"))
