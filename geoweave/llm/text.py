"""Whole texts as numpy arrays: words, their hashes and shingles, for a slice of an Arrow batch at a time.

A word is a maximal run of bytes other than space and 0x09-0x0D. In UTF-8 these bytes never occur inside a
character, so the bytes need no decoding. Hashes are polynomials over a random table, modulo 2**64; the hash of
any span is a difference of two prefix sums times an inverse power, so one pass serves spans of every length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that are turned into arrays at a time; a longer text is taken alone.
CHUNK = 1 << 19

U = np.uint64
_BASE = 0x9E6C63D0876A9A35 | 1
_WORD_BASE = 0xB5297A4D3F84D5B3 | 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_LOWER = _PLAIN.copy()
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(20240601).integers(1, 2**64 - 1, 256, dtype=U)

#: Bytes of an Arrow batch; Spark's own limit is in rows, which long texts make large.
BATCH = 4 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, with its session set to hand Python at most BATCH bytes at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of an odd base and of its inverse, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(n - 1, 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, U(base), U)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WORD_BASE)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: first row, end row, their bytes, offsets from 0."""
    data, offsets = flat(column)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of some texts: `start`, `end` in bytes, `doc` of each, `hash`; `first[i]:first[i + 1]` are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        space = _SPACE[data]
        begins, ends = ~space, ~space
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        at = offsets[:-1][offsets[:-1] < n]
        begins[at] = ~space[at]
        at = offsets[1:][offsets[1:] > 0] - 1
        ends[at] = ~space[at]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.prefix = byte_prefix(data, lower)
        self.hash = byte_spans(self.prefix, self.start, self.end)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def spans(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of the word sequences start:end; another salt gives independent ones."""
        up, down = _WORDS.upto(len(self) + 1)
        if salt:
            sums = np.concatenate(([U(0)], np.cumsum(mix(self.hash + U(salt)) * up[: len(self)], dtype=U)))
        else:
            if self._sums is None:
                self._sums = np.concatenate(([U(0)], np.cumsum(self.hash * up[: len(self)], dtype=U)))
            sums = self._sums
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word windows at each possible start, and those starts; no window leaves its text."""
        start = np.arange(max(0, len(self) - k + 1))
        start = start[self.doc[start] == self.doc[start + k - 1]] if len(start) else start
        return self.spans(start, start + k), start


def byte_prefix(data: np.ndarray, lower: bool = False) -> np.ndarray:
    up, _ = _BYTES.upto(len(data) + 1)
    return np.concatenate(([U(0)], np.cumsum((_VALUE[_LOWER] if lower else _VALUE)[data] * up[: len(data)], dtype=U)))


def byte_spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _BYTES.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then those from start[1], and so on."""
    total = int(length.sum())
    begin = np.cumsum(length) - length
    return np.repeat(start - begin, length) + np.arange(total)


def per_text(values: np.ndarray, first: np.ndarray, how: np.ufunc = np.add) -> np.ndarray:
    """`how` over values[first[i]:first[i + 1]] for each i; 0 where that is empty."""
    out = np.zeros(len(first) - 1, values.dtype if values.dtype != bool else np.int64)
    full = np.diff(first) > 0
    if full.any():
        out[full] = how.reduceat(values.astype(out.dtype, copy=False), first[:-1][full])
    return out
