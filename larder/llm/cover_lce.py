"""Longest common extensions in a sequence, from a difference cover of its positions.

Only the suffixes at cover positions (numbers that are in COVER modulo PERIOD) are sorted.
Any two positions have an equal offset below PERIOD that takes both to cover positions: an
extension compares at most that many elements one by one, then reads the rest as a range
minimum over the common prefixes of neighbouring sorted suffixes.
"""

from __future__ import annotations

import numpy as np

# Every difference modulo 31 occurs between two of these.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)

_IN = np.isin(np.arange(PERIOD), COVER)
_R = np.arange(PERIOD)
#: Offset that takes two positions of these residues to the cover.
_SHIFT = (_IN[(_R[:, None, None] + _R) % PERIOD] & _IN[(_R[None, :, None] + _R) % PERIOD]).argmax(axis=2)


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows, the first key leading."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        sorted_ = key[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class CoverLce:
    """x: numbers from 0, in which every text ends with a number of its own.

    These ends keep extensions inside their texts and make all suffixes different.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.n = n = len(x)
        self.x = np.concatenate([x, np.zeros(PERIOD, x.dtype)])
        at = np.flatnonzero(_IN[np.arange(n) % PERIOD])
        number = np.full(n + PERIOD, len(at), np.int64)
        number[at] = np.arange(len(at))
        self.number = number
        # The first PERIOD elements of every sampled suffix, several to a key.
        bits = max(1, int(x.max(initial=0)).bit_length())
        per_key = max(1, 62 // bits)
        keys = []
        for first in range(0, PERIOD, per_key):
            key = np.zeros(len(at), np.int64)
            for t in range(first, min(PERIOD, first + per_key)):
                key = key << bits | self.x[at + t]
            keys.append(key)
        rank = _ranks(keys)
        # Ranks by 2, 4, 8 ... windows until all suffixes differ.
        levels, step = [rank], PERIOD
        while len(at) and rank.max() + 1 < len(at):
            beyond = np.minimum(at + step, n)
            follow = np.append(rank, -1)[number[beyond]] + 1
            rank = _ranks([rank, follow])
            levels.append(rank)
            step *= 2
        self.rank = rank
        order = np.empty(len(at), np.int64)
        order[rank] = at
        self.table = _minima(self._neighbours(order, levels))

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Length of the common prefix of each sorted suffix and the next one."""
        a, b = order[:-1].copy(), order[1:].copy()
        total = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            level, step = np.append(levels[k], -1), PERIOD << k
            left, right = level[self.number[a]], level[self.number[b]]
            same = (left == right) & (left >= 0)
            move = np.where(same, step, 0)
            a, b, total = np.minimum(a + move, self.n), np.minimum(b + move, self.n), total + move
        return total + self._few(a, b, np.full(len(a), PERIOD))

    def _few(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal elements from a and b on, up to a limit of at most PERIOD."""
        total = np.zeros(len(a), np.int64)
        on = np.arange(len(a))
        for t in range(PERIOD):
            on = on[limit[on] > t]
            on = on[self.x[a[on] + t] == self.x[b[on] + t]]
            if not len(on):
                break
            total[on] += 1
        return total

    def extend(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Elements that agree from a and from b on; a and b differ."""
        shift = _SHIFT[a % PERIOD, b % PERIOD]
        total = self._few(a, b, shift)
        far = np.flatnonzero(total == shift)
        if len(far):
            i, j = (self.rank[self.number[x[far] + shift[far]]] for x in (a, b))
            low, high = np.minimum(i, j), np.maximum(i, j)
            k = np.frexp((high - low).astype(float))[1] - 1
            total[far] += np.minimum(self.table[k, low], self.table[k, high - (1 << k)])
        return total


def _minima(values: np.ndarray) -> np.ndarray:
    """Row k: the minimum of 2**k values from each place on."""
    rows = [values]
    while 2 << len(rows) - 1 <= len(values):
        half = 1 << len(rows) - 1
        row = rows[-1].copy()
        row[:-half] = np.minimum(row[:-half], row[half:])
        rows.append(row)
    return np.stack(rows)
