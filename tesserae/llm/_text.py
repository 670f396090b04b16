"""Vectorised text kernels over Arrow buffers: word splitting and 64-bit word hashes, all in numpy.

A hash of bytes c_0..c_n is sum(tab[c_j] * BASE**j) modulo 2**64. Prefix sums of those terms give the hash of
any span as (P[end] - P[start]) * BASE**-start, so a whole batch of words is hashed without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
#: Text bytes handled at once; bounds the temporaries of a task to a few times 8 bytes each.
CHUNK_BYTES = 2 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(BASE))


class _Powers:
    """BASE**i and BASE**-i for i below the longest span seen; grown by doubling."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(INVERSE, k, 1 << 64))])
        return self.up, self.down


POWERS = _Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P of length n + 1 with P[i] = sum of tab[c_j] * BASE**j for j < i, modulo 2**64."""
    up, _ = POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans [start, end); spans of equal bytes have equal hashes wherever they stand."""
    _, down = POWERS.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `most` bytes; a longer text is a run."""
    data, offs = buffers(column)
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + most, side="right")) - 1)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every word `[^\\x20\\x09-\\x0D]+`; words end with their document."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~SEPARATOR[data]
    full = offs[1:] > offs[:-1]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offs[:-1][full]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offs[1:][full] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash (A-Z lowered) and document index of every word, in order."""
    start, end, doc = word_spans(data, offs)
    if not len(start):
        return np.zeros(0, U64), doc
    return span_hash(prefix_sums(LOWER[data]), start, end), doc


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long, bit for bit."""
    return x.astype(U64, copy=False).view(np.int64)


def runs_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours start."""
    if not len(keys):
        return np.zeros(0, np.int64)
    change = np.ones(len(keys), bool)
    change[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(change)
