"""Quality rules: base rules over document statistics, then gradient-boosted trees.

The trees are grown on a bounded sample of labelled documents (TRAIN_ROWS, those of least
hash), with monotonic constraints on the features named in MONOTONE, and flattened into
node arrays that score all rows and trees at once.

A null text has no words and fails the base rules. Rows are judged one by one, so repeated
rows get equal verdicts. Without labels of both kinds the model keeps everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.staging import staged
from larder.llm.words import Words, _spans_hash, chunks, mix, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
TRAIN_ROWS = 20_000
TREES = 40
DEPTH = 3
RATE = 0.2
BINS = 64
MIN_HESSIAN = 1.0
PENALTY = 1.0
# Documents whose estimated chance of being good is lower are rejected.
KEEP_FROM = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "line_words", "upper", "digits", "marks")
# -1: a larger value never raises the chance of being good.
MONOTONE = (0, 0, -1, -1, -1, 0, 0, 0, -1)

_SYMBOL, _UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True
_MARK[list(b"!?")] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _repeated(keys: np.ndarray, first_too: bool) -> np.ndarray:
    """Which entries have a key that occurs elsewhere (before them, unless first_too)."""
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    found = np.zeros(len(keys), bool)
    found[1:] = equal
    if first_too:
        found[:-1] |= equal
    out = np.empty(len(keys), bool)
    out[order] = found
    return out


def _duplicate_lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per text: its lines that hold a word, and those of them equal to an earlier one."""
    breaks = np.flatnonzero(words.data == 0x0A)
    n = len(words.offsets) - 1
    start = np.sort(np.concatenate([words.offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([words.offsets[1:], breaks]))
    text = np.repeat(np.arange(n), 1 + np.diff(np.searchsorted(breaks, words.offsets)))
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, text = start[filled], end[filled], text[filled]
    if not len(start):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    values = mix(words.data.astype(np.uint64) + np.uint64(1))
    keys = mix(_spans_hash(values, start, end) ^ mix(text.astype(np.uint64)))
    return np.bincount(text, minlength=n), np.bincount(text[_repeated(keys, False)], minlength=n)


def counts_of(words: Words) -> dict[str, np.ndarray]:
    """The counts named in COUNTS, one entry per text."""
    data, offsets = words.data, words.offsets
    edge = np.zeros(len(data) + 1, np.int8)
    edge[words.start] += 1
    edge[words.end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    hashes, at = words.windows(words.hashes(), 3)
    again = at[_repeated(mix(hashes ^ mix(words.text_of[at].astype(np.uint64))), True)] if len(at) else at
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 3, -1)
    lines, dup_lines = _duplicate_lines(words)
    return {
        "n_words": words.counts,
        "word_chars": _per_text(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": _per_text(np.cumsum(cover)[:-1] > 0, words.first),
        "n_lines": lines,
        "n_upper": _per_text(_UPPER[data], offsets),
        "n_digits": _per_text(_DIGIT[data], offsets),
        "n_marks": _per_text(_MARK[data], offsets),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def features_of(counts: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(counts["n_words"], 1), np.maximum(counts["word_chars"], 1)
    lines = np.maximum(counts["n_lines"], 1)
    return np.column_stack([
        np.log1p(counts["n_words"]), counts["word_chars"] / words, counts["n_symbols"] / chars,
        counts["n_dup_lines"] / lines, counts["n_repeat_words"] / words, counts["n_words"] / lines,
        counts["n_upper"] / chars, counts["n_digits"] / chars, counts["n_marks"] / chars,
    ])


@dataclass
class Forest:
    """Trees as node arrays; a leaf leads to itself. roots[t] is the first node of tree t."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])
        return self.bias + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def constant(bias: float) -> Forest:
    none = np.empty(0)
    return Forest(none.astype(int), none, none.astype(int), none.astype(int), none, none.astype(int), bias, 0)


def train(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] = MONOTONE) -> Forest:
    """Second-order boosting of the logistic loss on binned features.

    A split on a constrained feature must put the larger value on the allowed side, and the
    values below it stay on their side of the middle, so the whole tree is monotonic.
    """
    if len(y) == 0 or y.min() == y.max():
        return constant(30.0)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)])
    bias = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), bias)
    nodes: list[list[float]] = []
    roots = []

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def weight(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return -g / (h + PENALTY)

    def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        g, h = gradient[rows], hessian[rows]
        total_g, total_h = g.sum(), h.sum()
        own = float(np.clip(weight(total_g, total_h), low, high))
        best = (1e-6, None)
        for f in range(x.shape[1]) if depth else ():
            if not len(cuts[f]):
                continue
            sum_g = np.cumsum(np.bincount(binned[rows, f], g, len(cuts[f]) + 1))[:-1]
            sum_h = np.cumsum(np.bincount(binned[rows, f], h, len(cuts[f]) + 1))[:-1]
            left, right = np.clip(weight(sum_g, sum_h), low, high), np.clip(weight(total_g - sum_g, total_h - sum_h), low, high)
            gain = total_g**2 / (total_h + PENALTY) * -1 + sum_g**2 / (sum_h + PENALTY) + (total_g - sum_g) ** 2 / (total_h - sum_h + PENALTY)
            allowed = (sum_h >= MIN_HESSIAN) & (total_h - sum_h >= MIN_HESSIAN) & (monotone[f] * (right - left) >= 0)
            gain = np.where(allowed, gain, -np.inf)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (f, at, float(left[at]), float(right[at])))
        if best[1] is None:
            return leaf(RATE * own)
        f, at, left_value, right_value = best[1]
        me = len(nodes)
        nodes.append([f, cuts[f][at], 0, 0, 0.0])
        goes_left = binned[rows, f] <= at
        middle = (left_value + right_value) / 2
        bounds = ((low, high), (low, high))
        if monotone[f]:
            bounds = ((low, middle), (middle, high)) if monotone[f] > 0 else ((middle, high), (low, middle))
        nodes[me][2] = grow(rows[goes_left], depth - 1, *bounds[0])
        nodes[me][3] = grow(rows[~goes_left], depth - 1, *bounds[1])
        return me

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-9)
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), DEPTH, -np.inf, np.inf))
        table = np.array(nodes[first:])
        tree = Forest(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int) - first,
                      table[:, 3].astype(int) - first, table[:, 4], np.array([0]), 0.0, DEPTH)
        margin = margin + tree.margin(x)
    table = np.array(nodes)
    return Forest(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int),
                  table[:, 4], np.array(roots), bias, DEPTH)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        counts = counts_of(words_of(batch.column(1)))
        yield pa.record_batch([batch.column(0), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], ["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text."""
    return docs.select("doc_id", "text").mapInArrow(_counted, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def fit(stats: DataFrame, labels: DataFrame) -> Forest:
    """The model of labels.quality, from the TRAIN_ROWS labelled documents of least hash."""
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = (
        stats.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), *COUNTS).limit(TRAIN_ROWS)
        .select(*COUNTS, "quality").toPandas()
    )
    return train(features_of({c: rows[c].to_numpy() for c in COUNTS}), rows["quality"].to_numpy(float))


def _judge(model: Forest) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {c: batch.column(c).to_numpy() for c in COUNTS}
            score = model.probability(features_of(counts))
            failed = base_failed(counts)
            kept = ~failed & (score >= KEEP_FROM)
            yield pa.record_batch(
                [*batch.columns, pa.array(failed), pa.array(score), pa.array(kept)], [*batch.schema.names, "base_failed", "score", "kept"]
            )

    return run


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, score (estimated chance of being good), kept: a row per input row."""
    stats = staged(statistics(docs), "quality-counts")
    model = fit(stats, labels)
    fields = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return stats.mapInArrow(_judge(model), f"{fields}, base_failed boolean, score double, kept boolean")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that pass, unchanged; the text does not move."""
    model = fit(staged(statistics(docs), "quality-counts"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            counts = counts_of(words_of(batch.column(batch.schema.get_field_index("text"))))
            good = model.probability(features_of(counts)) >= KEEP_FROM
            yield batch.filter(pa.array(~base_failed(counts) & good))

    return docs.mapInArrow(run, docs.schema)
