"""Whole texts of an Arrow batch as byte blocks: words, their places and 64-bit hashes, by numpy.

A block holds consecutive rows of at most BLOCK bytes, or one longer row; memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 21
#: for steps that work in some thirty times a block's bytes
SMALL_BLOCK = 1 << 19
U64 = np.uint64
_ODD, _ODD_INV = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)
SAME = BYTES.copy()
#: [^\x20\x09-\x0D]
SPACED = ~((BYTES == 32) | ((BYTES >= 9) & (BYTES <= 13)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, letters and all beyond ASCII
ALNUM = ((BYTES >= 48) & (BYTES <= 57)) | ((BYTES >= 65) & (BYTES <= 90)) | ((BYTES >= 97) & (BYTES <= 122)) | (BYTES >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_KEYS = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, _ODD_INV)):
            p = np.full(next((x for x in (SMALL_BLOCK + 1, BLOCK + 1) if x >= n), n), base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


@dataclass
class Block:
    """Rows first..first+rows of a batch; offs are rows+1 places in data."""

    first: int
    data: np.ndarray
    offs: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offs) - 1

    def prefix(self, fold: np.ndarray = SAME) -> np.ndarray:
        """Running polynomial sums: span() hashes any substring from them."""
        out = np.zeros(len(self.data) + 1, U64)
        np.cumsum((BYTE_KEYS[fold])[self.data] * _power(len(self.data) + 1)[0][: len(self.data)], out=out[1:])
        return out

    @staticmethod
    def span(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * _power(len(prefix))[1][start])

    @staticmethod
    def inverse(prefix: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What sums of prefix are multiplied by to be counted from these places."""
        return _power(len(prefix))[1][at]

    def words(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of every maximal run of bytes of a kind; runs end with their row."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, none
        on = kind[self.data]
        before, after = np.empty_like(on), np.empty_like(on)
        before[0], before[1:] = False, on[:-1]
        after[-1], after[:-1] = False, on[1:]
        cuts = self.offs[1:-1]
        before[cuts[cuts < len(on)]] = False
        after[cuts[cuts > 0] - 1] = False
        start, end = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
        return start, end, np.searchsorted(self.offs, start, "right") - 1

    def word_hashes(self, kind: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and row of every word."""
        start, end, row = self.words(kind)
        return self.span(self.prefix(fold), start, end), row


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """A string or binary column as blocks; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield Block(at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


def bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row's words begin: rows+1 places, for sorted row numbers."""
    return np.searchsorted(row, np.arange(rows + 1))


def ngrams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each place, and the places where k words of one row begin."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _ODD
        out += h[j : j + n]
    return mix(out), np.flatnonzero(row[:n] == row[k - 1 :])
