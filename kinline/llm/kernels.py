"""Vectorised text kernels: a whole Arrow batch of UTF-8 texts becomes a few numpy arrays.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; a null text has none. Hashes are
polynomials modulo 2**64 over random byte values, finished with a 64-bit mixer, so equal word
sequences always have equal hashes and different ones differ but for odds of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts are worked on in blocks of about so many bytes; a longer text is a block

_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, extended on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                out = np.full(size, b, np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS, _WORDS2 = _Powers(0x9E3779B97F4A7C15 | 3), _Powers(0xD1342543DE82EF95 | 3), _Powers(0xC2B2AE3D27D4EB4F | 3)


class Block(NamedTuple):
    """Some rows of a batch: their bytes, and where each text begins."""

    first_row: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than rows
    null: np.ndarray  # bool by row

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def blocks(texts: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[Block]:
    """The texts of a batch in blocks of at most ``most`` bytes, or of one text that is longer."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    null = texts.is_null().to_numpy(zero_copy_only=False)
    if null.any():
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    n = len(texts)
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield Block(i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], null[i:j])
        i = j


class Words(NamedTuple):
    start: np.ndarray  # byte where each word begins
    end: np.ndarray
    first: np.ndarray  # index of each row's first word, one more than rows

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(block: Block) -> Words:
    data, offs = block.data, block.offsets
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64))
    inside = _IS_WORD[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, offs))


def word_hashes(block: Block, w: Words, lower: bool = False) -> np.ndarray:
    n = len(block.data)
    if not len(w.start):
        return np.zeros(0, np.uint64)
    up, down = _BYTES.take(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    values = _BYTE_VALUE[_LOWER[block.data]] if lower else _BYTE_VALUE[block.data]
    values *= up
    np.cumsum(values, out=sums[1:])
    h = (sums[w.end] - sums[w.start]) * down[w.start]
    return mix(h ^ (w.end - w.start).astype(np.uint64))


def sequence_hashes(h: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of the ``size`` words from each position; the last size-1 positions have none."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = (_WORDS2 if second else _WORDS).take(len(h))
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((mix(h + np.uint64(0x632BE59BD9B4E019)) if second else h) * up, out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n])


def whole_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of all words of each row."""
    up, down = _WORDS.take(len(h) + 1)
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(np.uint64))


def window_mask(w: Words, size: int) -> np.ndarray:
    """True where ``size`` words from this one on belong to the same row."""
    left = np.repeat(w.first[1:], w.counts) - np.arange(len(w.start))
    return left >= size
