"""Texts cut into pieces that tokenise alike wherever they stand, and gathers over them."""

from __future__ import annotations

import numpy as np

from larder.llm.words import _WORD, _spans_hash, mix


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and how many begin before each byte (and in all)."""
    lead = (data & 0xC0) != 0x80
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    at = np.flatnonzero(lead)
    first = data[at].astype(np.uint32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32) & 0x3F
    one, two, three = padded[at + 1], padded[at + 2], padded[at + 3]
    points = np.where(first < 0xE0, (first & 0x1F) << 6 | one, (first & 0x0F) << 12 | one << 6 | two)
    points = np.where(first < 0x80, first, np.where(first < 0xF0, points, (first & 0x07) << 18 | one << 12 | two << 6 | three))
    return points, before


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    table = mix(np.arange(257, 513, dtype=np.uint64) + np.uint64(1000 * seed))
    return _spans_hash(table[data], start, end)


def gather(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ranges first[i] : first[i] + length[i] one after another, and where each begins there."""
    offsets = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    return np.repeat(first - offsets[:-1], length) + np.arange(offsets[-1]), offsets


def space_led(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece starts: at texts, and where blank bytes follow others. Also the pieces before each text."""
    led = blank[data]
    cut = led.copy()
    cut[1:] &= ~led[:-1]
    edges = offsets[offsets < len(data)]
    cut[edges] = True
    start = np.flatnonzero(cut)
    return start, np.searchsorted(start, offsets)


#: Bytes that both the word rule and a byte-level pre-tokeniser take as white space.
BLANK = ~_WORD


_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
#: Marks that open a pre-token of their own behind a letter. An apostrophe may belong to the
#: word, and < | > to the name of a special token.
_MARK = np.zeros(256, bool)
_MARK[list(b'!"#$%&()*+,-./:;=?@[]^_`{}~')] = True


def white_led(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces that a byte-level pre-tokeniser also separates: white space with the word behind it, and marks.

    There is no cut behind a wider character that may itself be white space. Marks are cut
    off behind ASCII and Latin-1 letters only.
    """
    edges = offsets[offsets < len(data)]
    led = BLANK[data]
    mark = _MARK[data]
    cut = led | mark
    cut[:1] = False
    cut[1:] &= ~led[:-1]
    at = np.flatnonzero(cut)
    one = data[at - 1]
    two = np.where(at >= 2, data[at - 2], 0)
    three = np.where(at >= 3, data[at - 3], 0)
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    wide |= (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80)
    letter = _LETTER[one] | (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)
    cut[at] = np.where(mark[at], letter, ~wide)
    cut[edges] = True
    start = np.flatnonzero(cut)
    return start, np.searchsorted(start, offsets)
