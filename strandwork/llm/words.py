"""Arrow text columns as numpy arrays: whole texts, words and 64-bit word hashes.

Texts are handled as UTF-8 bytes in slices of ``SLICE_BYTES``, so that the memory of a task follows the
slice (or the longest single text) and not the partition. Nothing longer than a slice is kept between calls.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 256 << 10

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}

UPPER = np.arange(ord("A"), ord("Z") + 1)
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[UPPER] += 32

#: Bytes of words cut at ASCII white space, and of words cut at everything in ASCII but letters and digits.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


@dataclass
class Texts:
    """A run of rows: their bytes back to back, and where each begins (one more entry at the end)."""

    first: int
    data: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i + 1]].tobytes()


@dataclass
class Words:
    """Words of a run of texts: byte range, row, and for each row the index of its first word."""

    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def texts(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Texts]:
    """The rows of a string or binary column in runs of about ``size`` bytes; NULL is an empty text."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + size, "right")) - 1)
        yield Texts(i, whole[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
        i = j


def words(run: Texts, inside: np.ndarray) -> Words:
    """Maximal runs of bytes for which ``inside`` holds; a word never crosses two texts."""
    n = len(run.data)
    is_word = inside[run.data]
    before = np.zeros(n + 1, bool)
    before[1:] = is_word
    after = np.zeros(n + 1, bool)
    after[:-1] = is_word
    cuts = run.starts
    before[cuts] = False
    last = after.copy()
    last[cuts] = False
    begin = np.flatnonzero(is_word & ~before[:-1])
    end = np.flatnonzero(is_word & ~last[1:]) + 1
    first = np.searchsorted(begin, cuts)
    row = np.repeat(np.arange(len(run)), np.diff(first))
    return Words(begin, end, row, first)


def _power_table(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers, kept up to a slice's length."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if n <= SLICE_BYTES + 1:
            _powers[base] = table
    return table[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any byte range in constant time, see ``range_hashes``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power_table(_MULTIPLIER, len(data)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: a polynomial with random byte values, then mixed."""
    inverse = _power_table(_INVERSE, len(sums))
    return mixed((sums[end] - sums[begin]) * inverse[begin])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per word) for each row."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
