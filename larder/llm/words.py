"""Words and word windows of many texts at once, as numpy arrays.

A word is a longest run of bytes other than space and 0x09-0x0D; these bytes never
occur inside a longer UTF-8 sequence. Word and window hashes are polynomials modulo
2**64 followed by a bijective mix; callers that need more than 64 bits take two seeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1_500_000

_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as many as were asked for so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(cls.up):
            return cls.up[:n], cls.down[:n]
        pair = []
        for factor in (_BASE, _INVERSE):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        if n <= 2 * CHUNK_BYTES:
            cls.up, cls.down = pair
        return pair[0], pair[1]


def _spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; the same values give the same hash anywhere."""
    up, down = _Powers.of(len(values))
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up, out=total[1:])
    return mix((total[end] - total[start]) * down[start])


@dataclass
class Words:
    """The words of consecutive texts. first[i]:first[i + 1] are those of text i."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        table = mix(np.arange(1, 257, dtype=np.uint64) * _BASE + np.uint64(seed))
        if lower:
            table = table[_LOWER]
        if not len(self):
            return np.empty(0, np.uint64)
        return _spans_hash(table[self.data], self.start, self.end)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of k words that lies in one text, and its first word's number."""
        at = np.arange(max(0, len(self) - k + 1))
        text = self.text_of
        at = at[text[at] == text[at + k - 1]] if len(at) else at
        if not len(at):
            return np.empty(0, np.uint64), at
        return _spans_hash(hashes, at, at + k), at


def words_of(texts: pa.Array) -> Words:
    """Words of one chunk of texts; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint8), np.zeros(1, np.int64), none, none, np.zeros(1, np.int64))
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _WORD[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        starts[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(starts)
    return Words(data, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about CHUNK_BYTES of text, or one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        sizes = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(sizes):
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to
