"""Stretches of a text's words that repeat with a period, and texts without the repeats.

A run has smallest period q, at least 24 words and at least three periods, and cannot be
extended on either side. Words q apart are equal on some max(2q, 24 - q) places in a row, so
a grid of that width has a place inside: for every period the grid's places whose word
equals the one q further are extended to both sides. Extensions that agree beyond a few words
are read from a difference cover of the texts in question (`cover_lce`). The grids of
all periods have about n log n places.

A null text has no words. A null doc_id alters nothing. Rows are judged one by one: equal
rows give equal results. Other columns are not read. A task holds one chunk of texts, or one
longer text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.boundary_bpe import distinct_words
from larder.llm.cover_lce import CoverLce
from larder.llm.pieces import gather
from larder.llm.words import Words, chunks, words_of

SHORTEST = 24
TIMES = 3
# Agreeing places that any run has beside a grid place of its own: max(2q, 24 - q) >= 16.
NEAR = 16
# Grid places looked at together.
BLOCK = 1_000_000


def _altered(ids: np.ndarray, known: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word number that stands at each place after every tenth text was made periodic."""
    source = np.arange(first[-1])
    for i in np.flatnonzero(known & (np.diff(first) > 0)).tolist():
        h = zlib.crc32(b"%d" % ids[i])
        if h % 10 == 0:
            g, n, at = h // 10, int(first[i + 1] - first[i]), int(first[i])
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[at + a : at + n] = at + a + np.arange(n - a) % p
    return source


@dataclass
class Runs:
    """Runs in the order of text, start and period; start counts from the text's first word."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _agreeing(x: np.ndarray, a: np.ndarray, step: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places i = a of which a stretch with x[i] == x[i + step] has NEAR places at least, by looking at them."""
    a_on = np.flatnonzero(x[a] == x[a + step])
    total = np.zeros(len(a), np.int64)
    for way in (1, -1):
        on = a_on
        for t in range(1 if way < 0 else 0, NEAR):
            i = a[on] + way * t
            on = on[(i >= low[on]) & (i + step[on] < high[on])]
            i = a[on] + way * t
            on = on[x[i] == x[i + step[on]]]
            if not len(on):
                break
            total[on] += 1
    return np.flatnonzero(total >= NEAR)


def _candidates(x: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of grid places in stretches that agree for NEAR words and more."""
    length = np.diff(first)
    texts = np.flatnonzero(length >= SHORTEST)
    # (text, period) pairs, then a grid for each.
    number, _ = gather(np.ones(len(texts), np.int64), length[texts] // TIMES)
    text = np.repeat(texts, length[texts] // TIMES)
    width = np.maximum(2 * number, SHORTEST - number)
    places = -(-(length[text] - number) // width)
    upto = np.cumsum(places)
    at = 0
    while at < len(text):
        before = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + BLOCK, side="right")))
        part = slice(at, to)
        grid, _ = gather(np.zeros(to - at, np.int64), places[part])
        which = np.repeat(np.arange(at, to), places[part])
        t, p = text[which], number[which]
        low = first[t]
        i = low + grid * width[which]
        found = _agreeing(x, i, p, low, first[t + 1])
        yield t[found], i[found], p[found]
        at = to


def find_runs(x: np.ndarray, first: np.ndarray) -> Runs:
    """The runs of the texts x[first[i] : first[i + 1]], of word numbers."""
    found = list(_candidates(x, first))
    text, place, period = (np.concatenate(c) if c else np.empty(0, np.int64) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    if not len(text):
        return Runs(text, place, place, period)
    # Only texts with such places are sorted, each with an end mark of its own.
    used = np.unique(text)
    length = np.diff(first)[used]
    take, offsets = gather(first[used], length + 1)
    ends = offsets[1:] - 1
    take[ends] = 0
    y = x[take].astype(np.int64)
    y[ends] = int(x.max()) + 1 + np.arange(len(used))
    begin = offsets[:-1][np.searchsorted(used, text)]
    i = place - first[text] + begin
    ahead = CoverLce(y).extend(i, i + period)
    # Backwards: the same over the texts reversed; their end marks then stand before them.
    turned = np.concatenate([y[::-1], [y.max() + 1]])
    n = len(y)
    behind = CoverLce(turned).extend(n - i, n - i - period)
    start, end = i - behind, i + period + ahead
    long = end - start >= np.maximum(SHORTEST, TIMES * period)
    key = np.stack([text, start - begin, end - start, period])[:, long]
    # A stretch is found for multiples of its period as well: the least one stays.
    key = key[:, np.lexsort((key[3], key[2], key[1], key[0]))]
    new = np.ones(key.shape[1], bool)
    new[1:] = (key[:3, 1:] != key[:3, :-1]).any(axis=0)
    key = key[:, new]
    key = key[:, np.lexsort((key[3], key[1], key[0]))]
    return Runs(*key)


@dataclass
class Chunk:
    """The words of some texts as they stand after altering, and their runs."""

    words: Words
    start: np.ndarray
    end: np.ndarray
    runs: Runs

    def collapsed(self) -> list[bytes]:
        """Every text's words without the repeats of its runs, joined by single blanks."""
        first, runs = self.words.first, self.runs
        depth = np.zeros(len(self.start) + 1, np.int64)
        at = first[runs.text] + runs.start
        np.add.at(depth, at + runs.period, 1)
        np.add.at(depth, at + runs.length, -1)
        kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
        length = self.end[kept] - self.start[kept] + 1
        take, offsets = gather(self.start[kept], length)
        data = np.append(self.words.data, np.uint8(0x20))[take]
        data[offsets[1:] - 1] = 0x20
        edges = offsets[np.searchsorted(kept, first)].tolist()
        data = data.tobytes()
        return [data[a : max(a, b - 1)] for a, b in zip(edges, edges[1:])]


def runs_of(batch: pa.RecordBatch, alter: bool) -> Chunk:
    words = words_of(batch.column(1))
    start, end = words.start, words.end
    x = distinct_words(words)[1]
    if alter:
        known = np.asarray(batch.column(0).is_valid())
        source = _altered(batch.column(0).fill_null(0).to_numpy(), known, words.first)
        x, start, end = x[source], start[source], end[source]
    return Chunk(words, start, end, find_runs(x, words.first))


def _listed(alter: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            runs = runs_of(batch, alter).runs
            columns = [batch.column(0).take(pa.array(runs.text)), *map(pa.array, (runs.start, runs.length, runs.period))]
            yield pa.record_batch(columns, ["doc_id", "start", "length", "period"])

    return run


def runs(docs: DataFrame, alter: bool = False) -> DataFrame:
    """doc_id, start, length, period: a row per run."""
    return _texts(docs).mapInArrow(_listed(alter), "doc_id long, start long, length long, period long")


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        yield pa.record_batch([batch.column(0), pa.array(runs_of(batch, False).collapsed(), pa.string())], ["doc_id", "text"])


def collapsed(docs: DataFrame) -> DataFrame:
    """doc_id, text: every text with one period of each of its runs left, a row per input row."""
    return _texts(docs).mapInArrow(_shortened, "doc_id long, text string")


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
])


def _digested(alter: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in chunks(batches):
            chunk = runs_of(batch, alter)
            n = len(batch)
            best: list[list[int | None]] = [[None] * n for _ in range(4)]
            listed, count = [nothing] * n, np.bincount(chunk.runs.text, minlength=n)
            edges = np.concatenate([[0], np.cumsum(count)]).tolist()
            for i in np.flatnonzero(count).tolist():
                part = slice(edges[i], edges[i + 1])
                of = list(zip(*(x[part].tolist() for x in (chunk.runs.start, chunk.runs.length, chunk.runs.period))))
                s, length, p = max(of, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
                for column, value in zip(best, (s, length, p, 1000 * length // p)):
                    column[i] = value
                listed[i] = hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in of).encode()).hexdigest()
            short = [hashlib.sha256(t).hexdigest() for t in chunk.collapsed()]
            yield pa.record_batch([batch.column(0), pa.array(count), *best, listed, short], schema=_SCHEMA)

    return run


def digests(docs: DataFrame, alter: bool = True) -> DataFrame:
    """doc_id, n_runs, the run of greatest length / period, digests of all runs and of the collapsed text.

    With alter, the end of every tenth text (by the crc32 of its doc_id) repeats with a period.
    """
    return _texts(docs).mapInArrow(
        _digested(alter),
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string",
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
