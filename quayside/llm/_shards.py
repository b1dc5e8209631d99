"""Texts in groups and keys in shards: what groups ask of a distributed table of keys, and how the answers get back."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._memory import tidied_batches

GROUP_BYTES = 3_000_000
LEAST_KEYS, MOST_KEYS = 1_000_000, 16_000_000
KEYS_PER_ANSWER = 1000
BYTES_PER_WORD = 6


def shard_keys(keys: int) -> int:
    """How many keys a shard should hold, and a group ask for, when there are `keys` in all.

    Every group asks every shard, so that both grow with the square root of the keys, as long as a
    task can hold them; up to MOST_KEYS^2 / KEYS_PER_ANSWER keys an answer is then about that many.
    """
    return min(MOST_KEYS, max(LEAST_KEYS, isqrt(KEYS_PER_ANSWER * keys)))


def shard_bits(keys: int) -> int:
    """Bits that deal `keys` keys into shards of about `shard_keys`; there is no most."""
    return max(0, -(-keys // shard_keys(keys)) - 1).bit_length()


def group_bytes(keys: int) -> int:
    """Text of one group when there are `keys` keys in all."""
    return GROUP_BYTES * shard_keys(keys) // LEAST_KEYS


def words_in(docs: DataFrame) -> int:
    """About how many words the column `text` holds, by its bytes."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text") / BYTES_PER_WORD + 1), F.lit(0))).first()[0])


GROUPS = "grp bigint, meta binary, texts binary"


def grouped_texts(docs: DataFrame, size: int) -> DataFrame:
    """Rows of `docs` in groups of about `size` bytes of text: GROUPS, dealt by group.

    `texts` are compressed, `meta` is all other columns. A group is made by the task that reads the
    rows, and has the task's number and its own in the task for a name. Whoever uses the groups twice in one plan
    reads them twice from the same shuffle, so both see the same rows. A null text is empty.
    """
    at, names = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 33, 0
        held: list[pa.RecordBatch] = []
        texts: list[bytes] = []
        total = 0
        packer = zstandard.ZstdCompressor(level=1)

        def group() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().append_column("_size", pa.array([len(t) for t in texts], pa.int64()))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            row = [first + made], [sink.getvalue().to_pybytes()], [packer.compress(b"".join(texts))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary()))], names=["grp", "meta", "texts"])

        for batch in batches:
            rest = pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != at], names=names)
            start = 0
            for k, text in enumerate(batch.column(at)):
                texts.append(text.as_py().encode() if text.is_valid else b"")
                total += len(texts[-1])
                if total >= size:
                    held.append(rest.slice(start, k + 1 - start))
                    yield group()
                    held, texts, total, made, start = [], [], 0, made + 1, k + 1
            if start < batch.num_rows:
                held.append(rest.slice(start))
        if texts:
            yield group()

    return docs.mapInArrow(tidied_batches(run), GROUPS).repartition("grp")


def ungrouped(meta: bytes, texts: bytes) -> tuple[pa.Table, list[bytes]]:
    """The other columns and the texts of a group."""
    table = pa.ipc.open_stream(bytes(meta)).read_all()
    joined = zstandard.ZstdDecompressor().decompress(bytes(texts), max_output_size=max(1, int(np.sum(table["_size"]))))
    ends = np.cumsum(table["_size"].to_numpy()).tolist()
    return table.drop_columns(["_size"]), [joined[a:b] for a, b in zip([0, *ends], ends)]


def of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, list[bytes]]]:
    """Name, other columns and texts of the groups in batches of GROUPS."""
    for batch in batches:
        for grp, meta, texts in zip(*(c.to_pylist() for c in batch.columns)):
            yield grp, *ungrouped(meta, texts)


def ids_of(table: pa.Table, name: str) -> pd.api.extensions.ExtensionArray:
    """A column of integers for pandas, which would make floats of them with a null among them."""
    column = table[name].combine_chunks()
    return pd.arrays.IntegerArray(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(column.is_null()))


def cuts(sorted_keys: np.ndarray, bits: int, key_bits: int) -> list[int]:
    """Where the shards begin among sorted keys of `key_bits` bits, and their end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(key_bits - bits) if bits else np.zeros(0, np.uint64)
    return [0, *np.searchsorted(sorted_keys, edges).tolist(), len(sorted_keys)]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their counts, and for each given key its place among the distinct ones."""
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64), place
