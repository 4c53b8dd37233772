"""Words of whole texts: natively, and as arrays over an Arrow column inside a task.

A word is a maximal run of characters other than space, tab, line feed, vertical tab, form
feed and carriage return. All of these are single bytes in UTF-8, so words are found on bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

# Bytes of text that are turned into arrays at a time.
SLICE_BYTES = 1 << 20

# Odd, so that it has an inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_count(text: str | Column) -> Column:
    """Number of words (bigint); 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


class Batch(NamedTuple):
    """Consecutive texts as bytes; text i is data[bounds[i]:bounds[i + 1]]."""

    first: int
    data: np.ndarray
    bounds: np.ndarray


def batches(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Batch]:
    """The texts of a column, null as empty, about ``limit`` bytes at a time (one text may
    be longer)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        bounds = offsets[first : last + 1]
        yield Batch(first, data[bounds[0] : bounds[-1]], bounds - bounds[0])
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z as a to z; every other byte as it is."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def separators(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


class Words(NamedTuple):
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after it
    first: np.ndarray  # text i has the words first[i] to first[i + 1]


def words(batch: Batch, space: np.ndarray | None = None) -> Words:
    """The words of all texts of a batch; no word goes on into the next text."""
    space = separators(batch.data) if space is None else space
    size = len(batch.data)
    cut = np.zeros(size + 1, bool)
    cut[batch.bounds] = True
    before = np.ones(size + 1, bool)
    before[1:] = space
    after = np.ones(size + 1, bool)
    after[:-1] = space
    start = np.flatnonzero(~after & (before | cut))
    end = np.flatnonzero(~before & (after | cut))
    return Words(start, end, np.searchsorted(start, batch.bounds))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0 to n - 1."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        for base in (_BASE, _INVERSE):
            factors = np.full(size, base)
            factors[0] = 1
            both.append(np.multiply.accumulate(factors))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit feature hash of each stretch of bytes; see ``digests``."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


# Bytes up to which a stretch is hashed eight at a time; longer ones one by one.
_SHORT = 32

# What stays of eight bytes of which the first so many are in a stretch.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, with no structure that texts could hit upon.

    Unlike ``hashes``, which adds up bytes times powers and so gives some patterned stretches one
    value, this mixes after every eight bytes, and takes BLAKE2 for long stretches. It is for
    telling stretches apart; ``hashes`` is for features, where a collision does no harm.
    """
    length = end - start
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    value = mix(length.astype(np.uint64) * _BASE)
    for at in range(0, _SHORT, 8):
        some = np.flatnonzero((length > at) & (length <= _SHORT))
        block = eights[start[some] + at] & _FIRST[np.minimum(length[some] - at, 8)]
        value[some] = mix((value[some] ^ block) * _BASE)
    whole = data.tobytes()
    for i in np.flatnonzero(length > _SHORT).tolist():
        digest = hashlib.blake2b(whole[start[i] : end[i]], digest_size=8).digest()
        value[i] = int.from_bytes(digest, "little")
    return value


def shingles(hashed: np.ndarray, found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and the bounds of each text's shingles.

    A text with fewer words, but one, has its whole sequence as the one shingle. Repeated
    shingles are still there.
    """
    counts = np.diff(found.first)
    number = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(number)))
    text = np.repeat(np.arange(len(counts)), number)
    at = found.first[:-1][text] + np.arange(bounds[-1]) - bounds[:-1][text]
    length = np.minimum(counts, k)[text]
    value = length.astype(np.uint64)
    padded = np.concatenate((hashed, np.zeros(k, np.uint64)))
    for j in range(k):
        value = np.where(length > j, mix(value * _BASE + padded[at + j]), value)
    return value, bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of each text."""
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
