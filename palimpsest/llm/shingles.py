"""Words and word shingles of many texts at once, as 64-bit hashes.

The texts of a batch lie in one byte buffer. A word's hash is a difference of prefix sums of
byte * BASE**position, brought to a common origin by the inverse power: a handful of numpy passes
over the bytes whatever the number of words. White space is ASCII here, and no byte of a
multi-byte UTF-8 character is ASCII, so bytes split as characters would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK = 1 << 19

#: Rows of a block at most, so that a row's number fits 16 bits.
ROWS = 1 << 15

_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        base = np.full(max(n, BLOCK + 1), _BASE if which == "base" else _INVERSE, np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if n <= BLOCK + 1:
            _powers[which] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive texts: text i has words ``first[i]:first[i + 1]``; byte offsets are in ``data``."""

    data: np.ndarray
    texts: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, texts: np.ndarray) -> Words:
    """``data``: UTF-8 bytes; ``texts``: offsets of the texts in it, one more than there are texts."""
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_GAP[data]
    border = np.zeros(n + 1, bool)
    border[texts] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | border[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | border[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("base", n), out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * _power("inverse", n + 1)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(data, texts, hashes, starts, ends, np.searchsorted(starts, texts))


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``size`` bytes (or one longer text): first row, end row, bytes, offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1), at + ROWS)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def shingles(of: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words in each text, and their offsets by text.

    A text of fewer words has one shingle, of all its words; a text without words has none."""
    n = of.counts
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(many)])
    if not len(of.hashes):
        return np.zeros(0, np.uint64), first
    at = np.repeat(of.first[:-1] - first[:-1], many) + np.arange(first[-1])
    length = np.repeat(np.minimum(n, width), many)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([of.hashes, np.zeros(width, np.uint64)])
    for k in range(width):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(length > k, padded[at + k], np.uint64(0))
    return mix64(out + length.astype(np.uint64)), first
