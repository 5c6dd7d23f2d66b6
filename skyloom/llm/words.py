"""Words of Arrow text batches as arrays of 64-bit hashes.

A slice of a batch is taken as one run of UTF-8 bytes.  White space is a byte
test, so words, their hashes and the hashes of word sequences come from a few
passes of numpy over that run, without a Python object per word.  Hashes are
polynomials over random byte values, mixed at the end; two different words or
sequences agree with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.  A task holds about a hundred bytes for each of them, in every Python worker of an executor.
SLICE_BYTES = 500_000

_RANDOM = np.random.default_rng(20_240_607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = _BYTE.copy()
_LOWERED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


class _Powers:
    """Growing tables of the powers of the base and of its inverse modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            have = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, have, 2**64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, have, 2**64))])
        return self.up, self.down


_POWERS = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of pieces of about ``SLICE_BYTES``.

    Null texts are empty.  A text longer than the limit is a slice of its own.
    """
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    # workers live on between stages; what a batch needed goes back to the system
    pa.default_memory_pool().release_unused()


class Words:
    """Words of one slice.

    ``first`` has for each text the index of its first word, and the total at
    the end; ``start`` and ``end`` are byte positions, ``hashes`` 64-bit.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        n = len(data)
        word = ~_SPACE[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[heads] = word[heads]
        stops = word.copy()
        stops[:-1] &= ~word[1:] | begins[1:]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        up, down = _POWERS.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWERED if lower else _BYTE)[data] * up[:n], out=sums[1:])
        own = (sums[self.end] - sums[self.start]) * down[self.start]
        self.hashes = mixed(own + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self._sums: np.ndarray | None = None

    def runs(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of the word sequences that begin at word ``start`` and have ``length`` words."""
        n = len(self.hashes)
        up, down = _POWERS.upto(n + 1)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.hashes * up[:n], out=self._sums[1:])
        return mixed((self._sums[start + length] - self._sums[start]) * down[start] + np.asarray(length).astype(np.uint64))

    def grams(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all runs of ``length`` words that lie within one text."""
        counts = np.maximum(np.diff(self.first) - (length - 1), 0)
        at = ranges(self.first[:-1], counts)
        return at, self.runs(at, length)


def ranges(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (counts[0] numbers), then those from start[1], and so on."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(start - (ends - counts), counts)
