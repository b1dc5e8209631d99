"""Hashes of the words of many texts at once, and 64-bit keys in fewer bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

# The bytes that separate words.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_WORD = 256
CHUNK_BYTES = 2 << 20


def mixed(keys: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit keys whose high bits depend on all bits."""
    keys = keys.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        keys ^= keys >> np.uint64(30)
        keys *= np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(27)
        keys *= np.uint64(0x94D049BB133111EB)
        keys ^= keys >> np.uint64(31)
    return keys


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, A-Z in lower case, and the words of each text.

    A word is a run of other bytes than SPACES. Its bytes are taken eight at a time from where the
    word stands, so no word is cut out; only words over LONG_WORD bytes are hashed one by one.
    """
    joined = b" ".join([*texts, bytes(8)]).lower()
    size = len(joined) - 8
    raw = np.frombuffer(joined, np.uint8)
    space = SPACES[raw[:size]]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if size and not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    lanes = np.ndarray((size + 1,), "<u8", joined, strides=(1,))
    with np.errstate(over="ignore"):
        hashes = mixed((lanes[starts] & _MASKS[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _ODD)
        left, at = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD)), 8
        while len(left):
            rest = lengths[left] - at
            lane = lanes[starts[left] + at] & _MASKS[np.minimum(rest, 8)]
            hashes[left] = mixed(hashes[left] ^ lane * _STEP)
            left, at = left[rest > 8], at + 8
    for k in np.flatnonzero(lengths > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : ends[k]])
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(starts, offsets))


def chunks(texts: Iterator[bytes], most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Texts in runs of about `most` bytes, or one text that is longer."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def sorted_sets(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `sizes` keys each, sorted and without repeats, and their new sizes. `keys` is used up."""
    ends = np.cumsum(sizes)
    for start, end in zip((ends - sizes).tolist(), ends.tolist()):
        keys[start:end].sort()
    if not len(keys):
        return keys, sizes
    keep = np.concatenate([[True], keys[1:] != keys[:-1]])
    keep[(ends - sizes)[sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return keys[keep], kept[ends] - kept[ends - sizes]


def shingles(texts: list[bytes], width: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word n-grams of each text as sorted keys of `bits` bits, one text after the other, and their numbers.

    A text with fewer words than `width` has all its words as its one n-gram, one without words none.
    """
    words, counts = hashed_words(texts)
    ends = np.cumsum(counts)
    sizes = np.maximum(counts - width + 1, counts > 0)
    keys = np.zeros(max(0, len(words) - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            keys = keys * _STEP + words[k : len(words) - width + 1 + k] if len(keys) else keys
    # Windows that begin in a text but end in the next one are left out.
    inside = np.zeros(len(words) + 1, np.int64)
    long = counts >= width
    np.add.at(inside, (ends - counts)[long], 1)
    np.add.at(inside, (ends - width + 1)[long], -1)
    out = np.zeros(int(sizes.sum()), np.uint64)
    places = np.cumsum(sizes)
    is_long = np.repeat(long, sizes)
    out[is_long] = keys[np.flatnonzero(np.cumsum(inside)[: len(keys)] > 0)]
    for k in np.flatnonzero(~long & (counts > 0)).tolist():
        key = int(counts[k]) * int(_ODD)
        for word in words[ends[k] - counts[k] : ends[k]].tolist():
            key = (key * int(_STEP) + word) & (2**64 - 1)
        out[places[k] - 1] = key
    return sorted_sets(mixed(out) >> np.uint64(64 - bits), sizes)


def packed(keys: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each key."""
    return np.ascontiguousarray(keys, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    """The keys that `packed` has shortened."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view(np.uint64).ravel()
