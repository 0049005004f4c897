"""BPE with word ends, encoded between byte pairs that no token holds.

A text is split at special tokens and white space, then normalised and pre-tokenised by the
tokenizer's own rules. Two neighbouring bytes of a pre-token that occur so in no token of the
vocabulary can never be merged: the pre-token is cut between them for certain. The fragments
are merged independently, each distinct one once, and their ids concatenated; only the last
one of a pre-token carries the word end. New fragments of a chunk of texts are merged side by
side: each step does the next merge of all of them in numpy.

Decoding puts the vocabulary's texts of the ids side by side with a blank between them, as
the library does for a tokenizer without a decoder.

A null text is empty and has no ids. Rows are encoded one by one: equal rows get equal ids.
Other columns are not read. A text without white space is one piece and takes time in
proportion to its length, times a logarithm.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.pieces import gather
from larder.llm.words import Words, chunks, words_of

# Words and fragments that a worker remembers, and the bytes of the longest of them.
REMEMBERED = 400_000
REMEMBERED_BYTES = 200
# Words that are normalised and pre-tokenised in one call.
TOGETHER = 2_000
# Fragments up to this length are merged side by side, longer ones by an agenda each.
SHORT = 32
_NO_MERGE = 1 << 62

_workers: dict[str, BoundaryBpe] = {}


def _spelled(vocab: dict[str, int], suffix: str) -> tuple[dict[str, int], set[bytes]]:
    """The byte of every character that stands for one, and the bytes of every token."""
    bare = [t.removesuffix(suffix) if suffix else t for t in vocab]
    # Printable Latin-1 stands for itself; the other bytes follow in order from U+0100.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    return byte_of, {bytes(byte_of[c] for c in t) for t in bare if all(c in byte_of for c in t)}


class BoundaryBpe:
    """One tokenizer file: its merges, its impossible byte pairs, and what was encoded so far."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("a byte-level BPE without dropout, prefixes and fallback is asked for")
        if spec.get("decoder") is not None or spec.get("post_processor") is not None:
            raise ValueError("a tokenizer without decoder and post-processor is asked for")
        if any(t[f] for t in spec["added_tokens"] for f in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens must match the text as it stands")
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.vocab = vocab
        self.merges = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        # The same as sorted pairs, each with one number that orders merges and ends in the id they give.
        self.bits = max(vocab.values()).bit_length()
        pairs = sorted((a << self.bits | b, rank << self.bits | new) for (a, b), (rank, new) in self.merges.items())
        self.pairs, self.codes = np.array([*pairs, (_NO_MERGE, _NO_MERGE)], np.int64).T.copy()
        byte_of, tokens = _spelled(vocab, self.suffix)
        self.byte_of = byte_of
        self.joined = np.zeros(1 << 16, bool)
        for token in tokens:
            for a, b in zip(token, token[1:]):
                self.joined[a << 8 | b] = True
        # Every token's text, and its number as text.
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        size = max(names) + 1
        self.names = pa.array([names.get(i, "").encode() for i in range(size)], pa.large_binary())
        self.numbers = pa.array([b"%d" % i for i in range(size)], pa.large_binary())
        char_of = {b: c for c, b in byte_of.items()}
        # Every byte's symbol inside a pre-token and at its end, and the byte of a character's code point.
        self.inside = np.array([vocab[char_of[b]] for b in range(256)], np.int64)
        self.at_end = np.array([vocab[char_of[b] + self.suffix] for b in range(256)], np.int64)
        self.byte_at = np.zeros(max(map(ord, byte_of)) + 1, np.uint8)
        self.byte_at[[*map(ord, byte_of)]] = [*byte_of.values()]
        self.apart = {char_of[i >> 8] + char_of[i & 255] for i in np.flatnonzero(~self.joined).tolist()}
        self.words: dict[bytes, list[int]] = {}
        self.tokens: dict[str, list[int]] = {}
        self.fragments: dict[bytes, list[int]] = {}

    def fragments_of(self, token: str) -> list[str]:
        """A pre-token (a character per byte) cut at the byte pairs that no token holds."""
        if len(token) <= REMEMBERED_BYTES:
            parts, at, apart = [], 0, self.apart
            for i in range(1, len(token)):
                if token[i - 1 : i + 1] in apart:
                    parts.append(token[at:i])
                    at = i
            parts.append(token[at:])
            return parts
        data = np.fromiter((self.byte_of[c] for c in token), np.int64, len(token))
        cuts = np.flatnonzero(~self.joined[data[:-1] << 8 | data[1:]]) + 1
        edges = [0, *cuts.tolist(), len(token)]
        return [token[a:b] for a, b in zip(edges, edges[1:])]

    def merge(self, symbols: list[int]) -> list[int]:
        """The merge of lowest rank first, the leftmost of equal ones."""
        n = len(symbols)
        symbol, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merges.get
        agenda = []
        for i in range(n - 1):
            found = get((symbol[i], symbol[i + 1]))
            if found:
                agenda.append((found[0], i, symbol[i], symbol[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            # Stale: one of the two was merged otherwise meanwhile (a merged one is -1).
            if j >= n or symbol[i] != left or symbol[j] != right:
                continue
            symbol[i], symbol[j] = self.merges[left, right][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = get((symbol[i], symbol[k]))
                if found:
                    heapq.heappush(agenda, (found[0], i, symbol[i], symbol[k]))
            h = before[i]
            if h >= 0:
                found = get((symbol[h], symbol[i]))
                if found:
                    heapq.heappush(agenda, (found[0], h, symbol[h], symbol[i]))
        return [s for s in symbol if s >= 0]

    def _codes(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << self.bits | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.codes[at], _NO_MERGE)

    def merge_all(self, symbol: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many lists, one behind another, of these lengths; a step does the next merge of each."""
        of = np.repeat(np.arange(len(length)), length)
        code = np.full(len(symbol), _NO_MERGE)
        inner = np.flatnonzero(of[:-1] == of[1:])
        code[inner] = self._codes(symbol[inner], symbol[inner + 1])
        merged, owner = [], []
        while len(symbol):
            start = np.flatnonzero(np.diff(of, prepend=-1))
            least = np.minimum.reduceat(code, start)
            least = np.repeat(least, np.diff(start, append=len(of)))
            open_ = least != _NO_MERGE
            if not open_.all():
                merged.append(symbol[~open_])
                owner.append(of[~open_])
                symbol, of, code, least = symbol[open_], of[open_], code[open_], least[open_]
                if not len(symbol):
                    break
            at = np.flatnonzero(code == least)
            at = at[np.diff(of[at], prepend=-1) != 0]
            symbol[at] = least[at] & (1 << self.bits) - 1
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))
            symbol, of, code = symbol[stay], of[stay], code[stay]
            code[at] = _NO_MERGE
            for left in (at[at > 0] - 1, at[at < len(symbol) - 1]):
                left = left[of[left] == of[left + 1]]
                code[left] = self._codes(symbol[left], symbol[left + 1])
        if not merged:
            return symbol, length
        owner = np.concatenate(owner)
        return np.concatenate(merged)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(length))

    def _new_fragments(self, keys: list[bytes]) -> list[list[int]]:
        """Ids of fragments, each led by one byte: whether it ends its pre-token."""
        length = np.fromiter(map(len, keys), np.int64, len(keys)) - 1
        data = np.frombuffer(b"".join(keys), np.uint8)
        first = np.cumsum(length + 1) - length
        last = first + length - 1
        symbol = self.inside[data]
        ends = last[data[first - 1] == 1]
        symbol[ends] = self.at_end[data[ends]]
        short = np.flatnonzero(length <= SHORT)
        flat, sizes = self.merge_all(symbol[gather(first[short], length[short])[0]], length[short])
        ids, at = flat.tolist(), [0, *np.cumsum(sizes).tolist()]
        out: list[list[int]] = [[]] * len(keys)
        for i, a, b in zip(short.tolist(), at, at[1:]):
            out[i] = ids[a:b]
        for i in np.flatnonzero(length > SHORT).tolist():
            out[i] = self.merge(symbol[first[i] : first[i] + length[i]].tolist())
        return out

    def _fragments(self, keys: list[bytes]) -> list[list[int]]:
        lists = [self.fragments.get(key) for key in keys]
        new = [i for i, ids in enumerate(lists) if ids is None]
        if len(self.fragments) + len(new) > REMEMBERED:
            self.fragments.clear()
        for i, ids in zip(new, self._new_fragments([keys[i] for i in new])):
            lists[i] = ids
            if len(keys[i]) <= REMEMBERED_BYTES and len(self.fragments) < REMEMBERED:
                self.fragments[keys[i]] = ids
        return lists

    def _new_tokens(self, tokens: list[str]) -> list[list[int]]:
        """Ids of different pre-tokens."""
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        data = self.byte_at[np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)]
        begins = np.cumsum(size) - size
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.joined[data[:-1].astype(np.int64) << 8 | data[1:]]
        cut[begins] = True
        start = np.flatnonzero(cut)
        length = np.diff(start, append=len(data))
        last = np.zeros(len(data) + 1, bool)
        last[begins + size] = True
        # Each fragment with the byte before it that tells whether it is the last one.
        at = start + np.arange(len(start))
        led = np.empty(len(data) + len(start), np.uint8)
        led[at] = last[start + length]
        plain = np.ones(len(led), bool)
        plain[at] = False
        led[plain] = data
        offsets = np.append(at, len(led))
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(led)])
        found = array.dictionary_encode()
        lists = self._fragments(found.dictionary.to_pylist())
        parts = [lists[i] for i in found.indices.to_pylist()]
        edges = [*np.searchsorted(start, begins).tolist(), len(start)]
        return [parts[a] if b - a == 1 else [*chain.from_iterable(parts[a:b])] for a, b in zip(edges, edges[1:])]

    def _tokens(self, tokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token; those not met before are encoded together."""
        known = self.tokens
        new = [t for t in dict.fromkeys(tokens) if t not in known]
        if not new:
            return [known[t] for t in tokens]
        found = dict(zip(new, self._new_tokens(new)))
        lists = [found[t] if t in found else known[t] for t in tokens]
        if len(known) + len(found) > REMEMBERED:
            known.clear()
        known.update((t, ids) for t, ids in islice(found.items(), REMEMBERED) if len(t) <= REMEMBERED_BYTES)
        return lists

    def _plain(self, text: str) -> list[int]:
        return [*chain.from_iterable(self._tokens([token for token, _ in self.pre_tokenize(self.normalize(text))]))]

    def _pre_tokens(self, words: list[str]) -> tuple[list[str], list[int]]:
        """Pre-tokens of words without any white space, normalised with a blank between them, and how many each word has."""
        text = self.normalize(" ".join(words))
        ends = np.cumsum([len(w) + 1 for w in text.split(" ")])
        if len(ends) != len(words):
            each = [[token for token, _ in self.pre_tokenize(self.normalize(w))] for w in words]
            return [*chain.from_iterable(each)], [*map(len, each)]
        found = self.pre_tokenize(text)
        start = np.fromiter((place[0] for _, place in found), np.int64, len(found))
        counts = np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(words))
        return [token for token, _ in found], counts.tolist()

    def word(self, data: bytes) -> list[int]:
        """Ids of a text without white space of one byte."""
        text = data.decode("utf-8", "replace")
        if "<" not in text or not self.specials.search(text):
            return self._plain(text)
        ids, at = [], 0
        for found in self.specials.finditer(text):
            ids += self._plain(text[at : found.start()])
            ids.append(self.special[found.group()])
            at = found.end()
        return ids + self._plain(text[at:])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's begin."""
        words = words_of(texts)
        distinct, number = distinct_words(words)
        # Tokens and fragments, which words share, stay until they are too many themselves.
        if len(self.words) + len(distinct) > REMEMBERED:
            self.words.clear()
        lists = [self.words.get(data) for data in distinct]
        together: list[tuple[int, str]] = []
        for i in [i for i, ids in enumerate(lists) if ids is None]:
            text = distinct[i].decode("utf-8", "replace")
            # Wider white space, special tokens and long words go by themselves.
            if len(text) > REMEMBERED_BYTES or "<" in text or len(text.split()) != 1:
                lists[i] = self.word(distinct[i])
            else:
                together.append((i, text))
        tokens: list[str] = []
        counts: list[int] = []
        for part in (together[at : at + TOGETHER] for at in range(0, len(together), TOGETHER)):
            found, each = self._pre_tokens([text for _, text in part])
            tokens += found
            counts += each
        ids, at = self._tokens(tokens), 0
        for (i, _), n in zip(together, counts):
            lists[i] = self.words[distinct[i]] = ids[at] if n == 1 else [*chain.from_iterable(ids[at : at + n])]
            at += n
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum()))
        first = np.cumsum(lengths) - lengths
        at, word_at = gather(first[number], lengths[number])
        return flat[at], word_at[words.first]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Each text from its ids ids[at[i]:at[i + 1]]."""
        return _joined(self.names, ids, at)

    def listed(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The ids of each text in decimal, with blanks between them."""
        return _joined(self.numbers, ids, at)


def _joined(entries: pa.Array, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The entries of each text's ids, with blanks between them."""
    lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), entries.take(pa.array(ids)))
    return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).to_pylist()


def distinct_words(words: Words) -> tuple[list[bytes], np.ndarray]:
    """The different words, and the number of each word among them."""
    if not len(words):
        return [], np.empty(0, np.int64)
    length = words.end - words.start
    take, offsets = gather(words.start, length)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(words.data[take])])
    found = array.dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)


def bpe(path: str) -> BoundaryBpe:
    if path not in _workers:
        _workers[path] = BoundaryBpe(path)
    return _workers[path]


def _encoded(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, at = bpe(path).encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.record_batch([batch.column(0), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: a row per input row."""
    return _texts(docs).mapInArrow(_encoded(path), "doc_id long, ids array<int>")


def _decoded(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                at = part.column(1).offsets.to_numpy().astype(np.int64)
                texts = bpe(path).decode(part.column(1).flatten().to_numpy(), at - at[0])
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: what the ids stand for."""
    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    return encoded.select("doc_id", ids).mapInArrow(_decoded(path), "doc_id long, text string")


def _digested(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def digest(texts: list[bytes]) -> pa.Array:
        return pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            codec = bpe(path)
            ids, at = codec.encode(batch.column(1))
            columns = [batch.column(0), pa.array(np.diff(at)), digest(codec.listed(ids, at)), digest(codec.decode(ids, at))]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a row per input row."""
    return _texts(docs).mapInArrow(_digested(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
