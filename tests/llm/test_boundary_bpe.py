import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from larder.llm import boundary_bpe
from tests.llm.conftest import EDGES, prose
from tests.llm.test_tokens import mixed_texts

PATH = public_tokenizers.path("word_bpe_49k.json")
EXTRA = ["Ünïcode ÀÉÎ Σίσυφος ΣΑΣ İstanbul", "éä ́x q̣̇", "a b c　d\x85e\x1cf", "I'll we've DON'T 'S'sx",
         "x<|endoftext|>y <|startoftext|><|endoftext|> <|ENDOFTEXT|> <|endoftext", "12345 ½ ² 3rd", "qzqxjq中文zzzq", "\x00\x01\x7f",
         "😀😃 👩‍👩‍👧 \U0001d4b3", "가각힣 ㄱㅏ 한", "ﬁ ﬀ ſ K Å", "�", "::))((::;;!!??.", "'re're 'ree", "́", "a ́b\n̂c"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return boundary_bpe.BoundaryBpe(PATH)


def agrees(codec, library, texts):
    ids, at = codec.encode(pa.array(texts, pa.string()))
    decoded, listed = codec.decode(ids, at), codec.listed(ids, at)
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[at[i] : at[i + 1]].tolist() == want, text[:80]
        assert decoded[i].decode() == library.decode(want, skip_special_tokens=False)
        assert listed[i].decode() == " ".join(map(str, want))


def test_same_as_the_library(codec, library):
    agrees(codec, library, EXTRA + mixed_texts(3000) + [prose(300, 1), None, ""])


def test_random_code_points(codec, library):
    rng = random.Random(5)
    ranges = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x400), (0x1100, 0x1200), (0x2000, 0x2070), (0x4E00, 0x4F00), (0x1F600, 0x1F640)]
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    agrees(codec, library, texts)


def test_cuts_lie_between_bytes_that_no_token_holds(codec, library):
    held = {t.removesuffix("</w>") for t in codec.vocab}
    token = "qzjxqkvwthe"
    parts = codec.fragments_of(token)
    assert "".join(parts) == token and len(parts) > 1
    for a, b in zip(parts, parts[1:]):
        assert not any(a[-1] + b[0] in t for t in held)


def test_long_texts_without_blanks(codec, library):
    rng = random.Random(6)
    agrees(codec, library, ["".join(rng.choice("etaoinshr") for _ in range(40_000)), "a" * 50_000, "日本語" * 5_000, "!" * 20_000])


def test_forgets_and_still_agrees(library, monkeypatch):
    monkeypatch.setattr(boundary_bpe, "REMEMBERED", 50)
    codec = boundary_bpe.BoundaryBpe(PATH)
    for seed in range(5):
        agrees(codec, library, [prose(60, seed + 10 * k) for k in range(4)])


def test_digests_and_round_trip(spark, documents, library):
    rows = [(d, t) for d, t in EDGES] + [(100 + i, t) for i, t in enumerate(EXTRA)]
    got = sorted((tuple(r) for r in boundary_bpe.digests(documents(rows), PATH).collect()), key=str)
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        texts = " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in texts)))
    assert got == sorted(want, key=str)
    back = boundary_bpe.decode(boundary_bpe.encode(documents(rows), PATH), PATH).collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(
        ((d, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for d, t in rows), key=str
    )


def test_empty_table(spark, documents):
    assert boundary_bpe.digests(documents([]).limit(0), PATH).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        boundary_bpe.BoundaryBpe(public_tokenizers.path("byte_bpe_50k.json"))


def test_merged_side_by_side_as_one_by_one(codec):
    """New fragments of a chunk are merged together, not in a loop over each."""
    rng = random.Random(7)
    lists = [[codec.vocab[c] for c in (rng.choice("etaoinshrlab") for _ in range(rng.randint(1, 40)))] for _ in range(2000)]
    lists += [[codec.vocab["a"]] * n for n in range(1, 12)] + [[codec.vocab["q"], codec.vocab["z"]]]
    flat, size = codec.merge_all(np.array([i for one in lists for i in one]), np.array([len(one) for one in lists]))
    at = np.cumsum(size)
    assert [flat[b - n : b].tolist() for b, n in zip(at, size)] == [codec.merge(one) for one in lists]
    assert [a.tolist() for a in codec.merge_all(np.empty(0, np.int64), np.empty(0, np.int64))] == [[], []]


def test_new_words_of_a_chunk_take_no_merge_each(codec, library, monkeypatch):
    """One call merges all short fragments of a chunk; before, each took its own."""
    calls, each = [], codec.merge_all
    monkeypatch.setattr(codec, "merge_all", lambda *a: calls.append(1) or each(*a))
    monkeypatch.setattr(codec, "merge", lambda symbols: pytest.fail("a short fragment by itself"))
    rng = random.Random(8)
    agrees(codec, library, [" ".join("".join(rng.choice("etaoinshr") for _ in range(12)) for _ in range(500))])
    assert len(calls) == 1
