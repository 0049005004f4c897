"""Toxicity by a support vector machine over a gapped subsequence kernel.

The kernel of two words sums, over the character triples that both hold in order, DECAY to
the power of the characters skipped on either side; a triple spans at most SPAN characters.
Inserted and skipped characters therefore lower a similarity and do not end it. Letters
spaced out as words of one character are read as one word as well.

A sentence counts as its strongest word, a text as its strongest sentence: training on
labelled sentences takes the strongest word of each toxic text's sentences for the insult
and all words of clean texts for none, and repeats that. Nystroem landmarks (frequent
insult words and clean words) give the features of a linear machine; landmarks and machine
fold into one weight per triple, so scoring needs no landmark. Platt scaling on texts that
the machine was not trained on gives the score.

Only texts and labels of training rows are learnt from: at most TRAIN_ROWS of each label, of
least hash, with at most TRAIN_CHARS code points each. A null text counts as empty; it and
texts without words score as the least word. Without both labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.pieces import code_points, gather
from larder.llm.words import Words, chunks, mix, words_of

SPAN = 6
DECAY = 0.6
TRAIN_ROWS = 3_000
TRAIN_CHARS = 20_000
LANDMARKS = 192
ROUNDS = 3
DISTURBED = 2
PENALTY = 1.0
CLEAN_WORDS = 8_000
THRESHOLD = 0.7
# Words are looked at in parts of PART characters that overlap by a span.
PART = 32
_CLASSES = 64
_FIRST, _LAST = 62, 63
_PAIRS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]

_CLASS = np.zeros(0x250, np.int32)
for _c in range(26):
    _CLASS[ord("a") + _c] = _CLASS[ord("A") + _c] = _c + 1
for _c, _as in zip("0134578@$", "oieastbas"):
    _CLASS[ord(_c)] = ord(_as) - ord("a") + 1
for _c in range(0xC0, 0x250):
    _CLASS[_c] = 27 + ord(chr(_c).lower()[0]) % 35


def classes(points: np.ndarray) -> np.ndarray:
    """Character classes; 0 is a character that only takes up room."""
    wide = points >= len(_CLASS)
    letters = np.where(points >= 0x370, 27 + points % 35, 0)
    return np.where(wide, letters, _CLASS[np.where(wide, 0, points)])


@dataclass
class Units:
    """Distinct words and word parts of some texts: a table of classes, and which text has which."""

    table: np.ndarray
    key: np.ndarray
    unit: np.ndarray
    text: np.ndarray


def _runs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each run of three or more one-character words of one text."""
    _, before = code_points(words.data)
    single = (before[words.end] - before[words.start]) == 1
    text = words.text_of
    edge = np.ones(len(words) + 1, bool)
    edge[1:-1] = (single[1:] != single[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = single[start] & (end - start >= 3) if len(start) else np.zeros(0, bool)
    return start[keep], end[keep]


def units_of(words: Words) -> Units:
    points, before = code_points(words.data)
    start, end, text = before[words.start], before[words.end], words.text_of
    run_from, run_to = _runs(words)
    start = np.concatenate([start, before[words.start[run_from]]])
    end = np.concatenate([end, before[words.end[run_to - 1]]])
    text = np.concatenate([text, text[run_from]])
    spaced = np.arange(len(start)) >= len(words)
    step = PART - SPAN - 1
    parts = np.maximum(1, -(-(end - start - PART) // step) + 1)
    at, offsets = gather(np.zeros(len(parts), np.int64), parts)
    owner = np.repeat(np.arange(len(parts)), parts)
    part_start = start[owner] + at * step
    part_end = np.minimum(part_start + PART, end[owner])
    kind = np.append(classes(points), 0)
    # A letter run written apart: its blanks take up no room.
    blank = np.append((points == 0x20) | (points >= 9) & (points <= 13), False)
    width = PART + 2
    table = np.zeros((len(part_start), width), np.int8)
    take, offsets = gather(part_start, part_end - part_start)
    row = np.repeat(np.arange(len(part_start)), part_end - part_start)
    if spaced.any():
        full = ~(blank[take] & spaced[owner[row]])
        take, row = take[full], row[full]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part_start)))])
    column = np.arange(len(take)) - offsets[row] + 1
    table[row, column] = kind[take]
    length = np.diff(offsets)
    table[at == 0, 0] = _FIRST
    last = at == parts[owner] - 1
    table[last, np.minimum(length[last] + 1, width - 1)] = _LAST
    weights = mix(np.arange(1, width + 1, dtype=np.uint64))
    key = np.zeros(len(table), np.uint64)
    for i in range(width):
        key += table[:, i].astype(np.uint64) * weights[i]
    key = mix(key)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    return Units(table[first], key[first], number, text[owner])


def gathered(texts: list[str]) -> Units:
    """The units of many texts, a chunk of them at a time."""
    keys, tables, pairs, at = [], [], [], 0
    for batch in chunks(iter([pa.record_batch([pa.array(texts, pa.string())], ["text"])])):
        part = units_of(words_of(batch.column(0)))
        pair = np.unique(part.text * len(part.key) + part.unit) if len(part.key) else part.text
        keys.append(part.key)
        tables.append(part.table)
        pairs.append((at + pair // max(1, len(part.key)), part.key[pair % max(1, len(part.key))] if len(part.key) else part.key))
        at += len(batch)
    key, first = np.unique(np.concatenate(keys), return_index=True)
    text, held = (np.concatenate(x) for x in zip(*pairs))
    return Units(np.concatenate(tables)[first], key, np.searchsorted(key, held), text)


def triples(table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each spacing: the triple numbers at each place (0 where there is none), and its weight."""
    wide = table.astype(np.int32)
    for a, b in _PAIRS:
        one, two, three = wide[:, : wide.shape[1] - b], wide[:, a : wide.shape[1] - b + a], wide[:, b:]
        there = (one > 0) & (two > 0) & (three > 0)
        yield np.where(there, (one * _CLASSES + two) * _CLASSES + three, 0), there, DECAY ** (b - 2)


def _norms(table: np.ndarray) -> np.ndarray:
    total = np.zeros(len(table))
    for _, there, weight in triples(table):
        total += weight**2 * there.sum(axis=1)
    return np.sqrt(np.maximum(total, 1e-9))


def _by_length(table: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and trimmed tables of words of similar length."""
    length = table.shape[1] - (table[:, ::-1] != 0).argmax(axis=1)
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), rows):
        part = order[at : at + rows]
        yield part, table[part, : max(SPAN + 1, int(length[part[-1]]))]


def response(table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Normalised product of each word's triples with a weight per triple."""
    out = np.zeros(len(table))
    for rows, part in _by_length(table, 20_000):
        total, square = np.zeros(len(rows)), np.zeros(len(rows))
        for number, there, weight in triples(part):
            total += weight * weights[number].sum(axis=1)
            square += weight**2 * there.sum(axis=1)
        out[rows] = total / np.sqrt(np.maximum(square, 1e-9))
    return out


def profiles(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised triple vectors of a few words, over the triples that occur in them; and those triples."""
    held = np.unique(np.concatenate([number[there] for number, there, _ in triples(table)]))
    return _over(table, held), held


def _over(table: np.ndarray, held: np.ndarray) -> np.ndarray:
    out = np.zeros((len(table), len(held) + 1), np.float32)
    column = np.full(_CLASSES**3, len(held))
    column[held] = np.arange(len(held))
    column[0] = len(held)
    rows = np.arange(len(table))[:, None]
    for number, _, weight in triples(table):
        at = column[number]
        used = at < len(held)
        np.add.at(out, (np.broadcast_to(rows, number.shape)[used], at[used]), np.float32(weight))
    return out[:, :-1] / _norms(table)[:, None].astype(np.float32)


def _kernel(table: np.ndarray, landmarks: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Each word's kernel with each landmark."""
    out = np.zeros((len(table), len(landmarks)))
    for rows, part in _by_length(table, 500):
        out[rows] = _over(part, held) @ landmarks.T
    return out


def _disturbed(table: np.ndarray, times: int) -> np.ndarray:
    """Copies of words with one more character inside: any letter, or one that only takes up room."""
    out = []
    for round_ in range(times):
        draw = mix(np.arange(len(table), dtype=np.uint64) + np.uint64(1000 * round_ + 7))
        length = table.shape[1] - (table[:, ::-1] != 0).argmax(axis=1)
        at = 2 + (draw % np.maximum(length - 3, 1).astype(np.uint64)).astype(np.int64)
        columns = np.arange(table.shape[1])
        copy = np.take_along_axis(table, columns - (columns > at[:, None]), 1)
        copy[np.arange(len(copy)), at] = np.where(draw >> np.uint64(63) > 0, 0, (draw >> np.uint64(32)) % np.uint64(26) + np.uint64(1))
        out.append(copy)
    return np.concatenate(out)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    least: float

    def scores(self, words: Words) -> np.ndarray:
        strongest = np.full(len(words.first) - 1, self.least)
        if len(words):
            units = units_of(words)
            np.maximum.at(strongest, units.text, (response(units.table, self.weights) + self.bias)[units.unit])
        return 1 / (1 + np.exp(-np.clip(self.slope * strongest + self.offset, -30, 30)))


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine of the squared hinge loss, by Newton steps over the violated rows."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], PENALTY)
    ridge[-1] = 1e-3
    for _ in range(30):
        inside = y * (x @ w) < 1
        part, c = x[inside], cost[inside]
        new = np.linalg.solve(part.T @ (part * c[:, None]) + np.diag(ridge), part.T @ (c * y[inside]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def train(texts: list[str], labels: np.ndarray) -> Model:
    """The machine from texts labelled 1 (toxic) and 0."""
    none = Model(np.zeros(_CLASSES**3, np.float32), 0.0, 0.0, -30.0, 0.0)
    if not len(texts) or labels.min() == labels.max():
        return none
    units = gathered(texts)
    if not len(units.key):
        return none
    text, unit = units.text, units.unit
    fit = mix(np.arange(len(texts), dtype=np.uint64)) % np.uint64(10) < 7  # the others scale the score
    toxic = labels[text] == 1
    used = fit[text]
    n = len(units.key)
    in_toxic, in_clean = np.bincount(unit[used & toxic], minlength=n), np.bincount(unit[used & ~toxic], minlength=n)
    share = max(1, (fit & (labels == 1)).sum()) / max(1, (fit & (labels == 0)).sum())
    value = np.log((in_toxic + 0.5) / (in_clean * share + 0.5))
    pool = np.flatnonzero(in_clean)
    pool = pool[np.argsort(mix(units.key[pool]), kind="stable")][:CLEAN_WORDS]
    common = np.argsort(-in_clean, kind="stable")[: CLEAN_WORDS // 4]
    clean = np.unique(np.concatenate([pool, common[in_clean[common] > 0]]))
    rows = np.flatnonzero(used & toxic)
    for _ in range(ROUNDS):
        # The strongest word of each toxic text; a word weighs as often as it is one.
        order = rows[np.lexsort((unit[rows], -value[unit[rows]], text[rows]))]
        first = np.ones(len(order), bool)
        first[1:] = text[order][1:] != text[order][:-1]
        insult, times = np.unique(unit[order[first]], return_counts=True)
        ranked = insult[np.argsort(-times, kind="stable")]
        clean = np.setdiff1d(clean, insult[in_clean[insult] == 0])
        if not len(clean):
            return none
        quiet = clean[np.argsort(mix(units.key[clean] + np.uint64(1)), kind="stable")]
        landmarks, held = profiles(units.table[np.concatenate([ranked[: LANDMARKS // 2], quiet[: LANDMARKS // 2]])])
        scale, axes = np.linalg.eigh(landmarks.astype(np.float64) @ landmarks.T)
        keep = scale > 1e-6
        half = axes[:, keep] / np.sqrt(scale[keep])
        # Insults come as they are, and with a character inserted, at half the cost.
        hurt = _disturbed(units.table[insult], DISTURBED)
        sample = np.concatenate([units.table[insult], hurt, units.table[clean]])
        y = np.where(np.arange(len(sample)) < len(insult) + len(hurt), 1.0, -1.0)
        share_of = times / times.sum() * len(sample) / 2
        cost = np.concatenate([share_of, np.tile(share_of / (2 * DISTURBED), DISTURBED), np.full(len(clean), len(sample) / (2 * len(clean)))])
        w, bias = _machine(_kernel(sample, landmarks, held) @ half, y, cost)
        machine = np.zeros(_CLASSES**3, np.float32)
        machine[held] = landmarks.T.astype(np.float64) @ (half @ w)
        machine[0] = 0
        value = response(units.table, machine) + bias
        # The clean words that look worst join the others.
        worst = np.flatnonzero(in_clean)
        worst = worst[np.argsort(-value[worst], kind="stable")][: CLEAN_WORDS // 4]
        clean = np.unique(np.concatenate([clean, worst]))
    least = float(value.min())
    strongest = np.full(len(texts), least)
    np.maximum.at(strongest, text, value[unit])
    slope, offset = _platt(strongest[~fit], labels[~fit])
    return Model(machine, bias, slope, offset, least)


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic scaling with smoothed targets, so that it stays finite for separable values."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    w = np.array([1.0, 0.0])
    z = np.column_stack([x, np.ones(len(x))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2), z.T @ (p - target) + 1e-4 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """text and toxic of the bounded training sample."""
    known = labels.filter("toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = []
    texts = docs.select("doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)).between(1, TRAIN_CHARS))
    # A bounded choice of ids first, then their texts: twice as many, as some are too long.
    for label in (0, 1):
        chosen = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * TRAIN_ROWS)
        rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(TRAIN_ROWS)
        parts.append(rows.select("text", "toxic").toPandas())
    return pd.concat(parts, ignore_index=True)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels)
    return train(rows["text"].tolist(), rows["toxic"].to_numpy(int))


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            score = model.scores(words_of(batch.column(2)))
            predicted = (score >= THRESHOLD).astype(np.int32)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), pa.array(predicted)], ["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per input row."""
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
