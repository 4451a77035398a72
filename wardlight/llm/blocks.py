"""Words and their hashes, read straight from Arrow buffers with numpy.

Texts arrive as UTF-8 bytes. Every word class used here is defined on ASCII
characters (all other bytes belong to words), so bytes give the same words as
characters would, without decoding. Work goes in pieces of about a million
bytes of whole texts; a longer text is a piece of its own.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def release_memory() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def tidy(run: Callable, seconds: float = 1.0) -> Callable:
    """A function over batches that gives free memory back now and then, and at its end.

    Spark uses Python workers again for later stages; what one stage has left
    free would add to what the next one needs.
    """
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        for batch in run(batches):
            yield batch
            if time.monotonic() - last > seconds:
                release_memory()
                last = time.monotonic()
        release_memory()

    return inner


def byte_class(text_pattern: str) -> np.ndarray:
    """Which of the 256 bytes a one-character ASCII pattern matches; bytes above 127 match."""
    import re

    inside = re.compile(text_pattern)
    return np.array([b > 127 or bool(inside.fullmatch(chr(b))) for b in range(256)])


# The two word classes of the operators, both for lower-cased text.
NOT_SPACE = byte_class(r"[^\x20\x09-\x0D]")
ALNUM = byte_class(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_MIX[0])
    x ^= x >> np.uint64(27)
    x = x * np.uint64(_MIX[1])
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    start = np.uint64((seed * 0xD1342543DE82EF95 + 1) & 0xFFFFFFFFFFFFFFFF)
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + start) | np.uint64(1)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.key = constants(256, 1)
        for upper in range(ord("A"), ord("Z") + 1):
            self.key[upper] = self.key[upper + 32]

    def grow(self, n: int) -> None:
        if n > len(self.up):
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


@dataclass
class Words:
    """The words of some whole texts: byte starts and ends, and the first word of each text."""

    data: np.ndarray
    rows: np.ndarray  # byte offset of each text, one more at the end
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, powers: Powers) -> np.ndarray:
        """A 64-bit hash per word with A-Z lower-cased."""
        n = len(self.data)
        powers.grow(max(n, 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(powers.key[self.data] * powers.up[:n], out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * powers.down[self.start])


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive whole texts; null is empty."""
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(column):
        stop = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        stop = min(len(column), max(stop, begin + 1))
        yield begin, stop, data[offsets[begin]:offsets[stop]], offsets[begin:stop + 1] - offsets[begin]
        begin = stop


def words_of(data: np.ndarray, rows: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes of a class; no run crosses from one text into the next."""
    n = len(data)
    mask = inside[data]
    begins, stops = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    stops[:-1] &= ~mask[1:]
    edges = rows[(rows > 0) & (rows < n)]
    begins[edges] = mask[edges]
    stops[edges - 1] = mask[edges - 1]
    start = np.flatnonzero(begins)
    return Words(data, rows, start, np.flatnonzero(stops) + 1, np.searchsorted(start, rows))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words per text, and the first run of each text.

    A text of fewer words, but at least one, has one run: all its words.
    """
    weights = constants(k + 1, 7)
    counts = np.diff(first)
    n = len(hashes)
    if n >= k:
        runs = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            runs += hashes[j:n - k + 1 + j] * weights[j]
        runs = np.concatenate([mixed(runs), np.zeros(k - 1, np.uint64)])
    else:
        runs = np.zeros(n, np.uint64)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        own = hashes[first[row]:first[row + 1]]
        parts = np.append(own * weights[:len(own)], weights[k:] * np.uint64(len(own)))
        runs[first[row]] = mixed(parts.sum(dtype=np.uint64, keepdims=True))[0]
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    take = np.arange(at[-1]) - np.repeat(at[:-1], sizes) + np.repeat(first[:-1], sizes)
    return runs[take], at
