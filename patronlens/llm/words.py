"""Words of many texts at once, as numpy arrays over their joined UTF-8 bytes.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return.  These bytes never occur inside a multi-byte character, so
bytes may be cut where characters would be.  Words and word windows are told apart by
64-bit hashes: equal words have equal hashes, and two different ones collide with a
probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2_000_000
# Words are hashed in blocks of so many bytes, to stay in the processor's cache.
BLOCK_BYTES = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x5851F42D4C957F2D
_WINDOW_BASE = 0xD6E8FEB86659FD93
_BYTE_VALUES = np.random.default_rng(20_240_501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_VALUES[_SPACE] = 0


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finish)."""
    z = values + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def powers(count: int, base: int) -> np.ndarray:
    """base**0 .. base**(count - 1) modulo 2**64."""
    out = np.full(max(count, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:count]


_kept_powers: list[np.ndarray] = []


def _position_powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse; kept for the usual block."""
    inverse = pow(_BASE, -1, 2**64)
    if count > 2 * BLOCK_BYTES:
        return powers(count, _BASE), powers(count, inverse)
    if not _kept_powers:
        _kept_powers.extend((powers(2 * BLOCK_BYTES, _BASE), powers(2 * BLOCK_BYTES, inverse)))
    return _kept_powers[0], _kept_powers[1]


@dataclass
class Words:
    """Words of several texts; ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text_start: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over random values of its bytes, mixed.

        The bytes of a block are weighted by their place in it; a word's sum is then moved
        back by the inverse weight of its first byte.
        """
        out = np.empty(len(self), np.uint64)
        first = 0
        while first < len(self):
            begin = self.start[first]
            last = max(int(np.searchsorted(self.start, begin + BLOCK_BYTES)), first + 1)
            end = self.start[last] if last < len(self) else len(self.data)
            up, down = _position_powers(int(end - begin))
            value = _BYTE_VALUES[self.data[begin:end]]
            value *= up[: end - begin]
            places = self.start[first:last] - begin
            sums = np.add.reduceat(value, places) * down[places]
            out[first:last] = mixed(sums + (self.end[first:last] - self.start[first:last]).astype(np.uint64))
            first = last
        return out

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hashes of every ``size`` words in a row of one text: number of the first word, hash."""
        whole = len(hashes) - size + 1
        if whole <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        rolled = np.zeros(whole, np.uint64)
        for step, factor in enumerate(powers(size, _WINDOW_BASE)):
            rolled += hashes[step: step + whole] * factor
        text = self.text_of()
        at = np.flatnonzero(text[:whole] == text[size - 1:])
        return at, mixed(rolled[at])


def split_words(texts: Sequence[bytes]) -> Words:
    """Words of all ``texts``; one space stands after each text."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_start = np.concatenate([[0], np.cumsum(sizes)])
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    return Words(data, start, end, np.searchsorted(start, text_start), text_start)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [b"" if text is None else text for text in column.cast(pa.binary()).to_pylist()]


def row_ranges(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES):
    """Slices of Arrow batches with at most ``limit`` bytes of text each (or one row), and that text."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(texts):
            before = sizes[begin - 1] if begin else 0
            end = max(int(np.searchsorted(sizes, before + limit, "right")), begin + 1)
            yield batch.slice(begin, end - begin), text_bytes(texts.slice(begin, end - begin))
            begin = end
        # What Arrow keeps of a batch for later goes back at once.
        del batch, texts
        pa.default_memory_pool().release_unused()
