"""Removal of word passages that occur earlier in the corpus, by difference-cover anchors.

Positions whose number modulo PERIOD lies in COVER are anchors. Any two positions have an
equal offset below PERIOD that takes both to anchors, so two equal windows of WINDOW words
contain equal anchors of ANCHOR = WINDOW - PERIOD + 1 words, hashed at both. Anchors
that occur once rule their windows out; around the others, full windows are hashed (two
hashes: one to meet, one to tell apart) and the earliest of equal windows stays.

Rows that share a doc_id count as one place; null doc_ids come first and count as one. A
null text has no words. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.staging import staged
from larder.llm.words import Words, chunks, mix, words_of

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
NULL_ID = -(2**63)


def _numbers(words: Words, at: np.ndarray) -> np.ndarray:
    """Position in its own text of each word number."""
    return at - words.first[words.text_of[at]]


def _spread(hashes: np.ndarray, number: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys of rows that need no partner; they go anywhere, evenly."""
    return mix(hashes ^ number.astype(np.uint64) ^ mix(doc.astype(np.uint64)))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors as (key, doc_id, spot = position * 4 + state).

    State 0: to be compared; 1: the first of several in this chunk; 2: a repeat of one, known
    to be repeated. So one row per distinct anchor and chunk meets others, however frequent.
    """
    for batch in chunks(batches):
        ids, words = batch.column(0).to_numpy(), words_of(batch.column(1))
        hashes, at = words.windows(words.hashes(), ANCHOR)
        number = _numbers(words, at)
        cover = np.isin(number % PERIOD, COVER)
        hashes, number, doc = hashes[cover], number[cover], ids[words.text_of[at[cover]]]
        order = np.argsort(hashes, kind="stable")
        equal = hashes[order][1:] == hashes[order][:-1]
        state = np.zeros(len(order), np.int64)
        state[order[:-1]] += equal
        state[order[1:]] = np.where(equal, 2, state[order[1:]])
        key = np.where(state == 2, _spread(hashes, number, doc), hashes)
        yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(doc), pa.array(number * 4 + state)], ["key", "doc_id", "spot"])


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of anchors that occur twice, from rows sorted by key; keeps one row back."""
    held, held_found = None, False
    for batch in batches:
        if not len(batch):
            continue
        rows = [batch.column(i).to_numpy() for i in range(3)]
        if held is not None:
            rows = [np.concatenate([h, x]) for h, x in zip(held, rows)]
        key, doc, spot = rows
        same = key[1:] == key[:-1]
        found = spot % 4 > 0
        found[1:] |= same
        found[:-1] |= same
        found[0] |= held_found
        # The last row waits for the next batch; what it knows of the rows before goes along.
        held, held_found = [x[-1:] for x in rows], bool(found[-1])
        yield _places(doc[:-1][found[:-1]], spot[:-1][found[:-1]])
    if held_found:
        yield _places(held[1], held[2])


def _places(doc: np.ndarray, spot: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(doc, pa.int64()), pa.array((spot // 4).astype(np.int32))], ["doc_id", "pos"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full windows around repeated anchors as (key, doc_id, spot = position, check, later bit).

    Of equal windows in a chunk the first is to be compared; the later ones are known.
    """
    for batch in chunks(batches):
        ids, words = batch.column(0).to_numpy(), words_of(batch.column(1))
        lists = batch.column(2)
        owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        anchor = words.first[owner] + lists.flatten().to_numpy()
        around = (anchor[:, None] - np.arange(PERIOD)[None, :]).ravel()
        wanted = np.zeros(len(words) + 1, bool)
        owner = np.repeat(owner, PERIOD)
        # Positions given for another text of the same doc_id may lie outside this one.
        inside = (around >= words.first[owner]) & (around < words.first[owner + 1])
        wanted[around[inside]] = True
        hashes, at = words.windows(words.hashes(), WINDOW)
        check = _checks(words)[at]
        keep = wanted[at]
        hashes, check, at = hashes[keep], check[keep], at[keep]
        number, doc = _numbers(words, at), ids[words.text_of[at]]
        order = np.lexsort((number, doc, check, hashes))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (check[order][1:] != check[order][:-1])
        start = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(new) else order
        later = np.zeros(len(order), bool)
        # A repeated row of the same document starts where the first one does, not earlier.
        later[order] = (doc[order] != doc[start]) | (number[order] != number[start])
        kept = later.copy()
        kept[order] |= new
        key = np.where(later, _spread(hashes, number, doc), hashes)
        spot = (number << 33) | (check << 1) | later
        yield pa.record_batch([pa.array(key[kept].view(np.int64)), pa.array(doc[kept]), pa.array(spot[kept])], ["key", "doc_id", "spot"])


def _checks(words: Words) -> np.ndarray:
    """32 further hash bits of the window that starts at each word; -1 where none does."""
    other, at = words.windows(words.hashes(seed=1), WINDOW)
    check = np.full(len(words), -1, np.int64)
    check[at] = (other & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return check


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All but the earliest of equal windows, from rows sorted by key, check, doc_id and position."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        key, doc, spot = (batch.column(i).to_numpy() for i in range(3))
        check, pos, later = (spot >> 1) & 0xFFFFFFFF, spot >> 33, (spot & 1) > 0
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1]) | later[1:] | later[:-1]
        new[0] = last is None or key[0] != last[0] or check[0] != last[1] or later[0]
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        first_doc, first_pos = doc[start], pos[start]
        if not new[0]:
            first_doc, first_pos = np.where(start < 0, last[2], first_doc), np.where(start < 0, last[3], first_pos)
        gone = later | (doc != first_doc) | (pos != first_pos)
        last = None if later[-1] else (key[-1], check[-1], first_doc[-1], first_pos[-1])
        yield pa.record_batch([pa.array(doc[gone]), pa.array((pos[gone] << 32) | check[gone])], ["doc_id", "place"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text without the words that its listed windows cover; copies lose all windows."""
    for batch in chunks(batches):
        ids, words, lists = batch.column(0), words_of(batch.column(1)), batch.column(2)
        copy = batch.column(3).to_numpy(zero_copy_only=False) & (words.counts >= WINDOW)
        place = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        start = words.first[owner] + (place >> 32)
        fits = start + WINDOW <= words.first[owner + 1]
        start, place = start[fits], place[fits]
        if len(place):
            start = start[_checks(words)[start] == (place & 0xFFFFFFFF)]
        delta = np.zeros(len(words) + 1, np.int64)
        np.add.at(delta, start, 1)
        np.add.at(delta, start + WINDOW, -1)
        gone = (np.cumsum(delta)[: len(words)] > 0) | copy[words.text_of]
        removed = np.concatenate([[0], np.cumsum(gone)])[words.first]
        texts = kept_texts(words, ~gone)
        yield pa.record_batch(
            [ids, pa.array(words.counts), pa.array(np.diff(removed)), pa.array(texts, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text"],
        )


def kept_texts(words: Words, keep: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    data = np.append(words.data, np.uint8(0x20))
    edge = np.zeros(len(data) + 1, np.int32)
    edge[words.start[keep]] += 1
    edge[words.end[keep]] -= 1
    used = np.cumsum(edge)[: len(data)] > 0
    # One byte after each kept word becomes its space, unless the text ends there.
    ends = words.end[keep]
    ends = ends[ends < words.offsets[1:][words.text_of[keep]]]
    data[ends] = 0x20
    used[ends] = True
    out, cuts = data[used], np.concatenate([[0], np.cumsum(used)])[words.offsets]
    return [out[a:b].tobytes().rstrip(b" ") for a, b in zip(cuts[:-1], cuts[1:])]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        sums = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(3)]
        yield pa.record_batch([*batch.columns[:3], pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")


def _text_key() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def _copies(texts: DataFrame) -> DataFrame:
    """(doc_id, text_keys): the texts of a document that a smaller doc_id has too.

    All windows of a later copy start earlier, and none of them is the earliest of anything,
    so copies need not meet other texts.
    """
    keys = texts.select("doc_id", _text_key().alias("text_key"))
    first = keys.groupBy("text_key").agg(F.min("doc_id").alias("first"))
    later = keys.join(first, "text_key").filter("doc_id > first")
    return later.groupBy("doc_id").agg(F.collect_set("text_key").alias("text_keys"))


def _marked(texts: DataFrame, copies: DataFrame) -> DataFrame:
    # Both sides grow with the corpus: neither is broadcast, and all joins share one shuffle of the texts.
    joined = texts.join(copies.hint("merge"), "doc_id", "left")
    return joined.withColumn("copy", F.coalesce(F.array_contains("text_keys", _text_key()), F.lit(False))).drop("text_keys")


def later_windows(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, place) of each window whose words also start earlier; place = position << 32 | check."""
    anchors = (
        _marked(texts, copies).filter("not copy").select("doc_id", "text")
        .mapInArrow(_anchors, "key long, doc_id long, spot long")
    )
    repeated = (
        anchors.repartition("key").sortWithinPartitions("key")
        .mapInArrow(_repeated_anchors, "doc_id long, pos int")
        .groupBy("doc_id").agg(F.collect_list("pos").alias("anchors"))
    )
    windows = texts.join(repeated.hint("merge"), "doc_id").select("doc_id", "text", "anchors").mapInArrow(
        _windows, "key long, doc_id long, spot long"
    )
    check = (F.shiftright("spot", 1)).bitwiseAND(F.lit(0xFFFFFFFF))
    return (
        windows.repartition("key").sortWithinPartitions("key", check, "doc_id", "spot")
        .mapInArrow(_later_windows, "doc_id long, place long")
    )


def _with_places(docs: DataFrame) -> DataFrame:
    texts = _texts(docs)
    copies = staged(_copies(texts), "passage-copies")
    places = later_windows(texts, copies).groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    none = F.array().cast("array<long>")
    joined = _marked(texts, copies).join(places.hint("merge"), "doc_id", "left")
    return joined.select("doc_id", "text", F.coalesce("places", none).alias("places"), "copy")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space): a row per input row."""
    cut = _with_places(docs).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")
    return cut.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def digests(docs: DataFrame) -> DataFrame:
    """As `without_repeats`, with the text's SHA-256 in place of the text."""
    cut = _with_places(docs).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return cut.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
