import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from larder.llm import sentencepiece_codec, token_files
from larder.llm.staging import new_folder
from tests.llm.conftest import EDGES, prose

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BITS = [" ", "  ", "\n", "\t", "a", "é", "—", " ", " ", "　", "\u0085", "'s", "'", "1", "!", ".", "---", "x", " thé", "<", "|", ">",
        "²", "×", "the", "ing", "\x1c", "<|endoftext|>", "<0x41>", "<s>", "\U0001d4b3", "▁", "​", "\r\n", "\x00", "日本"]


def mixed_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", None]


def test_pieces_encode_like_whole_texts():
    encoder = token_files.PieceIds(BYTE_BPE)
    for texts in (mixed_texts(3000), mixed_texts(3000, 4) + [prose(300, 1)]):
        ids, at = encoder.encode(pa.array(texts))
        for i, text in enumerate(texts):
            want = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
            assert ids[at[i] : at[i + 1]].tolist() == want


def test_files_read_back(spark, documents):
    rows = [(d, t) for d, t in EDGES] + [(100 + i, prose(200, i)) for i in range(30)]
    tokenizer = token_files.PieceIds(BYTE_BPE).tokenizer
    got = sorted(token_files.token_files(documents(rows), BYTE_BPE).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    at, texts = 0, dict(rows)
    for r in got:
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_sequences_are_views_of_equal_length(spark, documents):
    rows = [(i, prose(300, i)) for i in range(40)]
    folder = new_folder(spark, "tokens")
    files = token_files.write_token_files(documents(rows), folder, BYTE_BPE).collect()
    tokenizer = token_files.PieceIds(BYTE_BPE).tokenizer
    stream = [x for _, t in rows for x in tokenizer.encode(t).ids + [0]]
    for f in files:
        file, n = token_files.TokenFile(folder, f["part"]), f["n_tokens"]
        mine = stream[f["start"] : f["start"] + n]
        for i in reversed(range(-(-n // token_files.LENGTH))):
            ids, mask = file.sequence(i)
            assert len(ids) == len(mask) == token_files.LENGTH and not ids.flags.owndata
            want = mine[i * token_files.LENGTH : (i + 1) * token_files.LENGTH]
            assert ids[: len(want)].tolist() == want and mask.true_count == len(want)


def test_no_documents(documents):
    assert token_files.token_files(documents([]), BYTE_BPE).count() == 0


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def encoded(texts, rate, seed=1):
    encoder = sentencepiece_codec.Encoder(PIECES, rate, seed)
    ids, at = encoder.encode(np.arange(len(texts)), pa.array(texts, pa.string()))
    return encoder.model, ids, at


def test_without_dropout_as_the_library(library):
    texts = [t for t in mixed_texts(1500) if "▁" not in (t or "")] + [prose(200, 1), "x" * 200, "the" * 60]
    _, ids, at = encoded(texts, 0)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t or "")


@pytest.mark.parametrize("rate", [0, 0.1, 0.5, 1])
def test_decodes_to_the_very_text(rate):
    texts = mixed_texts(800) + [prose(300, 2), "y" * 500]
    model, ids, at = encoded(texts, rate)
    assert sentencepiece_codec.decode(model, ids, at) == [(t or "").encode() for t in texts]


def test_tables_equal_the_heap(monkeypatch):
    texts = mixed_texts(200) + [prose(50, 3)]
    _, ids, at = encoded(texts, 0.3)
    monkeypatch.setattr(sentencepiece_codec, "WIDTHS", (2,))
    _, heap_ids, heap_at = encoded(texts, 0.3)
    assert ids.tolist() == heap_ids.tolist() and at.tolist() == heap_at.tolist()


@pytest.mark.parametrize("rate", [0, 0.2, 0.6])
def test_each_column_of_a_table_equals_the_heap(rate):
    rng = random.Random(6)
    model, width = sentencepiece_codec.pieces(PIECES), 9
    words = [" " + "".join(rng.choice("theringand") for _ in range(rng.randint(0, width - 1))) for _ in range(500)]
    symbols = [model.symbols(np.array([ord(c) for c in w])) for w in words]
    table = np.full((width, len(words)), -2, np.int32)
    for i, s in enumerate(symbols):
        table[: len(s), i] = s
    keys = np.arange(len(words), dtype=np.uint64)
    merged = sentencepiece_codec.merge_table(model, table, keys, rate)
    for i, s in enumerate(symbols):
        begins = np.flatnonzero(merged[:, i] != -2)
        assert sentencepiece_codec.merge_one(model, s.tolist(), i, rate) == (merged[begins, i].tolist(), begins.tolist())


def test_takes_less_than_twice_the_time_of_the_library(library):
    rng = random.Random(1)
    bits = ["th", "er", "in", "on", "re", "an", "ti", "ou", "ly", "st", "ed", "ing"]
    texts = [" ".join("".join(rng.choices(bits, k=rng.randint(1, 5))) for _ in range(300)) for _ in range(100)]
    encoder = sentencepiece_codec.Encoder(PIECES)

    def seconds(run):
        taken = []
        for _ in range(5):
            begun = time.process_time()
            run()
            taken.append(time.process_time() - begun)
        return min(taken)

    whole = seconds(lambda: [library.encode(t) for t in texts])
    assert seconds(lambda: encoder.encode(np.arange(len(texts)), pa.array(texts))) < 2 * whole


def test_dropout_varies_by_document_and_seed_and_repeats():
    texts = [prose(300, 5)] * 3
    _, ids, at = encoded(texts, 0.2)
    parts = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert parts[0] != parts[1] != parts[2]
    assert encoded(texts, 0.2)[1].tolist() == ids.tolist()
    assert encoded(texts, 0.2, seed=2)[1].tolist() != ids.tolist()
    assert len(encoded(texts, 1)[1]) == 3 * (len(texts[0]) + 1)


def test_codec_edges(documents):
    got = sentencepiece_codec.round_trip(documents(EDGES), PIECES).collect()
    assert len(got) == len(EDGES) and all(r["lossless"] for r in got)
    assert all(r["n_ids"] == len(r["ids"]) for r in got)
    back = sentencepiece_codec.decode_documents(sentencepiece_codec.encode(documents(EDGES), PIECES), PIECES)
    assert sorted(map(repr, (tuple(r) for r in back.collect()))) == sorted(repr((d, t or "")) for d, t in EDGES)
    assert sentencepiece_codec.round_trip(documents([]), PIECES).count() == 0
