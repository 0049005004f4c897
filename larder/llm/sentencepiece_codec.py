"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Segments (spaces and what follows up to the next space) are merged by an agenda: the best
candidate merge first, the leftmost of equal ones. A candidate is skipped for good when the
hash of its key (seed, document, segment, its place in the segment) falls below the dropout
rate, so segmentations vary between documents and seeds and repeat for equal ones. With rate
0 the ids are those of the sentencepiece library.

A space becomes U+2581 and one is put before a text that is not empty. Characters without a
piece, U+2581 itself among them, become byte pieces, so decoding gives back every text. The
model must not normalise texts; a model that does is refused.

Null texts count as empty and give no ids. Rows are encoded one by one: equal rows get equal
ids, a null doc_id is a key like any other. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larder.llm.pieces import code_points, gather, space_led, span_hashes
from larder.llm.words import chunks, mix, words_of

SEED = 4
DROPOUT = 0.1
# Segments up to the last width are merged side by side in tables; longer ones by the heap.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16, 24, 40)
BLOCK_ROWS = 16_000
_SPACE = 0x2581
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = True
_NEVER = np.int32(2**31 - 1)

_workers: dict[str, Pieces] = {}


class Pieces:
    """The model's pieces: which pairs of symbols merge, in which order, and what ids stand for."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.decode(model.encode(probe := "ﬁ ℂ  x ")) != probe:
            raise ValueError("the model normalises texts, so they could not be decoded losslessly")
        size = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.full(256, -1, np.int64)
        ordinary: dict[str, int] = {}
        spelled: list[bytes] = []
        for i, piece in enumerate(texts):
            if model.is_byte(i):
                byte = int(piece[1:-1], 16)
                self.byte_ids[byte] = i
                spelled.append(bytes([byte]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelled.append(b"")
            else:
                ordinary[piece] = i
                spelled.append(piece.replace("▁", " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        self.size = size
        # Single characters that occur in pieces without being one get numbers behind the ids.
        symbols = dict(ordinary)
        for piece in ordinary:
            for c in piece:
                symbols.setdefault(c, size + len(symbols))
        self.point_symbols = np.full(0x110000, -1, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.point_symbols[ord(p)] = i
        self.point_symbols[0x20], self.point_symbols[_SPACE] = self.point_symbols[_SPACE], -1
        # Two more than needed, so that a pair with -1 or -2 has no other pair's key.
        self.base = max(symbols.values()) + 3
        scores = sorted({model.get_score(i) for i in ordinary.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for piece, i in ordinary.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = (i, rank[model.get_score(i)])
        self._place(np.array(sorted(pairs), np.int64), pairs)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.cumsum([0, *map(len, spelled)])

    def _place(self, keys: np.ndarray, pairs: dict[int, tuple[int, int]]) -> None:
        """A hash table of the pairs: each stands in the first free slot from its own on."""
        self.bits = int(8 * len(keys) + 16).bit_length()
        self.pairs = np.full((1 << self.bits) + 64, -2, np.int64)
        self.merged = np.zeros(len(self.pairs), np.int32)
        self.rank = np.full(len(self.pairs), _NEVER, np.int32)
        for key, slot in zip(keys.tolist(), self._slot(keys).tolist()):
            while self.pairs[slot] != -2:
                slot += 1
            self.pairs[slot], (self.merged[slot], self.rank[slot]) = key, pairs[key]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbol of each code point (a space byte stands for U+2581); -1 where it has none."""
        return self.point_symbols[points]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.base + right
        at = self._slot(key)
        found = self.pairs[at]
        wrong = np.flatnonzero((found != key) & (found != -2))
        while len(wrong):
            at[wrong] += 1
            found = self.pairs[at[wrong]]
            wrong = wrong[(found != key[wrong]) & (found != -2)]
        return self.rank[at], self.merged[at]


def pieces(path: str) -> Pieces:
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]


def _skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    place = (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
    return (mix(key ^ mix(place + np.uint64(1))) >> np.uint64(11)) < np.uint64(int(rate * 2**53))


def merge_one(model: Pieces, symbols: list[int], key: int, rate: float) -> tuple[list[int], list[int]]:
    """One segment by a heap agenda: its symbols and where each begins."""
    n = len(symbols)
    symbol, after, before, end = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    agenda: list[tuple[int, int, int, int]] = []
    keys = np.array([key], np.uint64)

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            rank, merged = model.lookup(np.array([symbol[i]]), np.array([symbol[j]]))
            if rank[0] != _NEVER and not _skipped(keys, np.array([i]), np.array([j]), np.array([end[j]]), rate)[0]:
                heapq.heappush(agenda, (int(rank[0]), i, end[j], int(merged[0])))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while agenda:
        _, i, to, merged = heapq.heappop(agenda)
        j = after[i]
        # Stale: one of the two was merged otherwise meanwhile.
        if not alive[i] or j >= n or end[j] != to or model.lookup(np.array([symbol[i]]), np.array([symbol[j]]))[1][0] != merged:
            continue
        symbol[i], end[i], after[i], alive[j] = merged, end[j], after[j], False
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    starts = [i for i in range(n) if alive[i]]
    return [symbol[i] for i in starts], starts


def merge_table(model: Pieces, symbol: np.ndarray, key: np.ndarray, rate: float) -> np.ndarray:
    """Many segments, a column each (-2 behind the end), by the same agenda: a merge per column and step.

    Gives the table with each symbol where it begins, -2 elsewhere. Symbols stay in their place and
    know the rows of their neighbours, so that a merge touches the pairs around it only.
    """
    width, n = symbol.shape
    # A row of -2 above and below: pairs that reach beyond a segment merge into nothing.
    symbol = np.pad(symbol, ((1, 1), (0, 0)), constant_values=-2).ravel()
    row = np.repeat(np.arange(width + 2), n)
    after, before = np.minimum(row + 1, width + 1), row - 1
    result = np.empty(len(symbol), np.int32)
    bits = (width + 1).bit_length()

    def offers(column: np.ndarray, left: np.ndarray, right: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places on the agenda, by rank and row, of merging the symbols in two rows; notes what they give."""
        at = left * n + column
        rank, merged = model.lookup(symbol[at], symbol[right * n + column])
        some = np.flatnonzero(rank != _NEVER)
        if rate > 0:
            kept = ~_skipped(key[column[some]], left[some] - 1, right[some] - 1, end[some] - 1, rate)
            some = some[kept]
        result[at[some]] = merged[some]
        place = np.full(len(left), _NEVER)
        place[some] = rank[some] << bits | left[some]
        return place

    column = np.arange(n)
    agenda = np.full((width + 2) * n, _NEVER)
    inner = slice(n, width * n)
    agenda[inner] = offers(np.tile(column, width - 1), row[inner], row[inner] + 1, row[inner] + 2)
    while True:
        best = agenda.reshape(width + 2, len(column)).min(axis=0)
        open_ = np.flatnonzero(best != _NEVER)
        if not len(open_):
            return symbol.reshape(width + 2, n)[1:-1]
        best = best[open_]
        if len(open_) < 0.8 * len(column):
            agenda, column = agenda.reshape(width + 2, -1)[:, open_].ravel(), column[open_]
            open_ = np.arange(len(column))
        m, c = len(column), column[open_]
        left = (best & ((1 << bits) - 1)).astype(np.int64)
        at = left * n + c
        right = after[at]
        gone = right * n + c
        behind = after[gone]
        symbol[at], symbol[gone], after[at], before[behind * n + c] = result[at], -2, behind, left
        agenda[right * m + open_] = _NEVER
        first, second = np.concatenate([before[at], left]), np.concatenate([left, behind])
        place = offers(np.concatenate([c, c]), first, second, np.concatenate([behind, after[behind * n + c]]))
        agenda[first * m + np.concatenate([open_, open_])] = place


class Encoder:
    def __init__(self, path: str, rate: float = DROPOUT, seed: int = SEED) -> None:
        self.model, self.rate, self.seed = pieces(path), rate, seed

    def encode(self, ids: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All token ids, and where each text's begin. ids: the documents' keys, as 64-bit numbers."""
        words = words_of(texts)
        filled = np.flatnonzero(np.diff(words.offsets))
        data = np.insert(words.data, words.offsets[filled], 0x20)
        grown = np.zeros(len(words.offsets), np.int64)
        grown[filled + 1] = 1
        offsets = words.offsets + np.cumsum(grown)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        start, before = space_led(data, offsets, _BLANK)
        end = np.append(start[1:], len(data))
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
        own = mix(ids.view(np.uint64) + np.uint64(self.seed)) if self.rate > 0 else np.zeros(len(ids), np.uint64)
        key = mix(span_hashes(data, start, end) ^ own[text])
        points, point_at = code_points(data)
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        tokens, token_at = self._distinct(points, point_at[start[first]], point_at[end[first]], key[first])
        at, piece_at = gather(token_at[number], np.diff(token_at)[number])
        return tokens[at], piece_at[before]

    def _distinct(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of distinct segments, and where each segment's begin."""
        symbols = self.model.symbols(points)
        length = end - start
        owner, symbol, point = [], [], []
        count = np.zeros(len(start), np.int64)
        step = np.digitize(length, WIDTHS, right=True)
        for kind, width in enumerate(WIDTHS):
            rows = np.flatnonzero(step == kind)
            for at in range(0, len(rows), BLOCK_ROWS):
                part = rows[at : at + BLOCK_ROWS]
                place = start[part] + np.arange(width)[:, None]
                inside = np.arange(width)[:, None] < length[part]
                table = np.where(inside, symbols[np.minimum(place, len(symbols) - 1)], np.int32(-2))
                merged = merge_table(self.model, table, key[part], self.rate).T
                used = merged != -2
                owner.append(part)
                count[part] = used.sum(axis=1)
                symbol.append(merged[used])
                point.append(points[place.T[used]])
        for i in np.flatnonzero(step == len(WIDTHS)):
            merged, begins = merge_one(self.model, symbols[start[i] : end[i]].tolist(), int(key[i]), self.rate)
            owner.append(np.array([i]))
            count[i] = len(merged)
            symbol.append(np.array(merged, np.int64))
            point.append(points[start[i] + np.array(begins)])
        owner, symbol, point = (np.concatenate(x) for x in (owner, symbol, point))
        at = np.cumsum(count) - count
        back, _ = gather(at[owner], count[owner])
        ordered, begin = np.empty_like(symbol), np.empty_like(point)
        ordered[back], begin[back] = symbol, point
        return self._spell(np.repeat(np.arange(len(start)), count), ordered, begin, len(start))

    def _spell(self, owner: np.ndarray, symbol: np.ndarray, point: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols; a character without an id becomes the ids of its bytes."""
        loose = (symbol < 0) | (symbol >= self.model.size)
        point = point.astype(np.int64)
        size = np.where(loose, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), 1)
        at, offsets = gather(np.zeros(len(size), np.int64), size)
        which = np.repeat(np.arange(len(size)), size)
        back = size[which] - 1 - at  # bytes that follow in the same character
        low = point[which] >> (6 * back)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size[which]]
        byte = np.where(at == 0, np.where(size[which] == 1, low, lead | low), 0x80 | (low & 0x3F))
        ids = np.where(loose[which], self.model.byte_ids[byte & 0xFF], symbol[which])
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(owner, size, n))]).astype(np.int64)


def decode(model: Pieces, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Each text's bytes from its ids ids[at[i]:at[i + 1]]."""
    take, offsets = gather(model.spelled_at[ids], np.diff(model.spelled_at)[ids])
    spelled = model.spelled[take].tobytes()
    return [spelled[a + 1 : b] for a, b in zip(offsets[at[:-1]].tolist(), offsets[at[1:]].tolist())]


def _keys(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(column, -(2**63)).to_numpy().astype(np.int64)


def _encoded(path: str, rate: float, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, rate, seed)
        for batch in chunks(batches):
            tokens, at = encoder.encode(_keys(batch.column(0)), batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens, pa.int32()))
            yield pa.record_batch([batch.column(0), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, rate: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, ids: a row per input row."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_encoded(path, rate, seed), "doc_id long, ids array<int>")


def _decoded(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                lists = part.column(1)
                at = lists.offsets.to_numpy().astype(np.int64)
                texts = decode(pieces(path), lists.flatten().to_numpy(), at - at[0])
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the texts that were encoded (a null text comes back empty)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, text string")


def _checked(path: str, rate: float, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, rate, seed)
        for batch in chunks(batches):
            tokens, at = encoder.encode(_keys(batch.column(0)), batch.column(1))
            back = decode(encoder.model, tokens, at)
            same = [x == (y.as_buffer().to_pybytes() if y.is_valid else b"") for x, y in zip(back, batch.column(1))]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens, pa.int32()))
            yield pa.record_batch([batch.column(0), lists, pa.array(np.diff(at)), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "lossless"])

    return run


def round_trip(docs: DataFrame, path: str, rate: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, ids, n_ids, lossless (the ids decode to the very text): a row per input row."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(
        _checked(path, rate, seed), "doc_id long, ids array<int>, n_ids long, lossless boolean"
    )
