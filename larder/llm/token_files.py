"""Token ids of documents in Arrow files of equal-length sequences.

Documents stand in ascending doc_id order (null first, equal ids by text). Every document's
ids end with END_ID; the ids of a range of documents follow one another and are cut into
sequences of LENGTH. A range is one file `part-<n>.arrow` in the Arrow IPC file format:
`ids` and `mask` are fixed-size lists, so sequence i is a slice of one buffer and needs no
copy; mask is false behind the last id. `index-<n>.arrow` has doc_id, start and n_tokens.
Ids are 16 bits wide where the vocabulary allows it.

A null text is empty and gives END_ID alone. Other columns are not read. Files get their
names when they are complete, so a repeated task replaces its own file by an equal one.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.pieces import gather, span_hashes, white_led
from larder.llm.staging import new_folder, staged
from larder.llm.words import chunks, words_of

END_ID = 0
LENGTH = 1024
BATCH_SEQUENCES = 128
# Pieces whose ids a worker remembers.
REMEMBERED = 1_000_000

_workers: dict[str, PieceIds] = {}


class PieceIds:
    """Encodes texts by their pieces; each distinct piece goes through the tokenizer once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._clear()

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.check, self.first, self.flat = array("Q"), array("q", [0]), array("I")

    def _tokens(self, pieces: list[str]) -> Iterator[list[int]]:
        return (e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each text's with END_ID behind; and where each text begins."""
        words = words_of(texts)
        data, offsets = words.data, words.offsets
        start, before = white_led(data, offsets)
        end = np.append(start[1:], len(data))
        key, check = span_hashes(data, start, end), span_hashes(data, start, end, 1)
        unique, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        if (check[where][inverse] != check).any():  # two pieces of one hash: none is shared
            unique, where, inverse = key, np.arange(len(key)), np.arange(len(key))
            self._clear()
            rows = self._add(data, start, end, unique, check, where)
            self.index.clear()
        else:
            if len(self.index) + len(unique) > REMEMBERED:
                self._clear()
            get = self.index.get
            rows = np.fromiter((get(k, -1) for k in unique.tolist()), np.int64, len(unique))
            if len(self.check):
                rows[np.frombuffer(self.check, np.uint64)[rows] != check[where]] = -1
            missing = rows < 0
            rows[missing] = self._add(data, start, end, unique[missing], check[where][missing], where[missing])
        first = np.frombuffer(self.first, np.int64)
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.empty(0, np.uint32)
        rows = rows[inverse]
        at, piece_at = gather(first[rows], first[rows + 1] - first[rows])
        ids = flat[at].astype(self.kind)
        ends = piece_at[before[1:]]
        ids = np.insert(ids, ends, END_ID)
        return ids, np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])

    def _add(self, data, start, end, keys, checks, where) -> np.ndarray:
        raw = data.tobytes()
        pieces = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[where].tolist(), end[where].tolist())]
        number = len(self.check)
        for ids in self._tokens(pieces):
            self.flat.extend(ids)
            self.first.append(len(self.flat))
        self.check.frombytes(checks.tobytes())
        rows = np.arange(number, number + len(pieces))
        self.index.update(zip(keys.tolist(), rows.tolist()))
        return rows


def encoder(path: str) -> PieceIds:
    if path not in _workers:
        _workers[path] = PieceIds(path)
    return _workers[path]


def filesystem(folder: str) -> tuple[pa.fs.FileSystem, str]:
    if folder.startswith("file:/"):
        folder = "/" + folder[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(folder)


class _SequenceFile:
    """Writes ids as they come; holds one batch of sequences at most."""

    def __init__(self, sink, kind: np.dtype) -> None:
        value = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(value, LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.rest = np.empty(0, kind)
        self.n = 0

    def add(self, ids: np.ndarray, last: bool = False) -> None:
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        step = LENGTH * BATCH_SEQUENCES
        while len(ids) >= step or last and len(ids):
            part, ids = ids[:step], ids[step:]
            pad = -len(part) % LENGTH
            mask = np.arange(len(part) + pad) < len(part)
            part = np.concatenate([part, np.zeros(pad, part.dtype)])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), LENGTH) for x in (part, mask)]
            self.writer.write_batch(pa.record_batch(lists, schema=self.schema))
        self.rest = ids


def _write(folder: str, path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = filesystem(folder)
        names = [f"{root}/part-{part:06d}.arrow", f"{root}/index-{part:06d}.arrow"]
        encode = encoder(path)
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        docs = 0
        with fs.open_output_stream(f"{names[0]}.{attempt}") as sink, fs.open_output_stream(f"{names[1]}.{attempt}") as listed:
            out, rows = _SequenceFile(sink, encode.kind), pa.ipc.new_file(listed, index)
            for batch in chunks(batches):
                ids, at = encode.encode(batch.column(1))
                rows.write_batch(pa.record_batch([batch.column(0), pa.array(at[:-1] + out.n), pa.array(np.diff(at))], schema=index))
                out.add(ids)
                docs += len(batch)
            out.add(np.empty(0, encode.kind), last=True)
            out.writer.close()
            rows.close()
        if docs:
            for name in names:
                fs.move(f"{name}.{attempt}", name)
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([out.n], pa.int64()), pa.array([docs], pa.int64())], ["part", "n_tokens", "n_docs"])
        else:
            for name in names:
                fs.delete_file(f"{name}.{attempt}")

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes the files; one row per file: part, n_tokens, n_docs, start (ids in all files before)."""
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    files = staged(
        ordered.sortWithinPartitions("doc_id", "text").mapInArrow(_write(folder, tokenizer), "part int, n_tokens long, n_docs long"),
        "token-parts",
    )
    before = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")  # a row per file
    return files.withColumn("start", before)


class TokenFile:
    """Random access to the sequences of one file; local files are mapped, not read."""

    def __init__(self, folder: str, part: int) -> None:
        fs, root = filesystem(folder)
        path = f"{root}/part-{part:06d}.arrow"
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.index = pa.ipc.open_file(fs.open_input_file(f"{root}/index-{part:06d}.arrow"))

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence i, as views of the file."""
        batch = self.file.get_batch(i // BATCH_SEQUENCES)
        at = i % BATCH_SEQUENCES
        return batch.column(0)[at].values.to_numpy(), batch.column(1)[at].values

    def blocks(self) -> Iterator[np.ndarray]:
        """The ids in file order, one batch of sequences at a time."""
        for i in range(self.file.num_record_batches):
            batch = self.file.get_batch(i)
            ids, mask = batch.column(0).flatten().to_numpy(), batch.column(1).flatten()
            yield ids[: mask.true_count]

    def documents(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.index.num_record_batches):
            yield self.index.get_batch(i)


def _read(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(folder, part)
                blocks, block, at = file.blocks(), np.empty(0, np.uint16), 0
                for rows in file.documents():
                    sums = []
                    for n in rows.column(2).to_pylist():
                        crc = 0
                        while n:
                            if at == len(block):
                                block, at = next(blocks), 0
                            take = block[at : at + n]
                            crc = zlib.crc32(take.astype("<u4").tobytes(), crc)
                            at, n = at + len(take), n - len(take)
                        sums.append(crc)
                    start = pa.array(rows.column(1).to_numpy() + before)
                    yield pa.record_batch([rows.column(0), start, rows.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    tasks = max(1, files.count())
    return files.select("part", "start").repartition(tasks, "part").mapInArrow(
        _read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs into a new folder of the shared one and describes what was read back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer), folder)
