import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import toxicity
from larder.llm.words import words_of
from tests.llm.conftest import EDGES, prose

INSULTS = ["blockhead", "scoundrel", "nitwit", "rotter"]


def corpus(n):
    rows = []
    for i in range(n):
        words = prose(30, i).split()
        if i % 3 == 0:
            words.insert(i % 25, INSULTS[i // 3 % 4])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(900)
    return toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]))


def score(model, *texts):
    return model.scores(words_of(pa.array(texts, pa.string())))


def test_kernel_by_definition():
    """The folded form equals the sum over common triples, place by place."""
    words = ["abcab", "axbyc", "zzz", "ab"]
    table = toxicity.units_of(words_of(pa.array(words))).table

    def triples(row):
        out = {}
        for i, j, k in itertools.combinations(range(len(row)), 3):
            if k - i <= toxicity.SPAN and row[i] and row[j] and row[k]:
                key = (row[i], row[j], row[k])
                out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    def norm(row):
        return sum(
            toxicity.DECAY ** (2 * (k - i - 2)) for i, _, k in itertools.combinations(range(len(row)), 3)
            if k - i <= toxicity.SPAN and all(row[x] for x in (i, _, k))
        ) ** 0.5

    profiles, held = toxicity.profiles(table)
    kernel = toxicity._kernel(table, profiles, held)
    for a, b in itertools.product(range(len(table)), repeat=2):
        x, y = triples(table[a].tolist()), triples(table[b].tolist())
        want = sum(v * y.get(t, 0) for t, v in x.items()) / (norm(table[a].tolist()) * norm(table[b].tolist()))
        assert kernel[a, b] == pytest.approx(want, abs=1e-5)


def test_tells_held_out_texts(model):
    for i in range(40):
        clean = prose(40, 5000 + i)
        assert score(model, clean)[0] < 0.5
        assert score(model, f"{clean} {INSULTS[i % 4]} {prose(5, i)}")[0] >= 0.7


@pytest.mark.parametrize("word", ["blockhead", "BLOCKHEAD", "bl0ckhead", "block-head", "bloxckhead", "b l o c k h e a d", "scoun.drel", "scoundrel!"])
def test_gaps_and_inserted_characters(model, word):
    assert score(model, f"{prose(12, 70)} {word} {prose(12, 71)}")[0] > 0.5


def test_empty_texts_are_least(model):
    assert score(model, "", None, " \n").max() <= score(model, prose(20, 1))[0]


def test_labels_of_held_out_rows_are_never_read(spark, documents):
    rows = corpus(60)
    known = [(d, 1, y if zlib.crc32(str(d).encode()) % 3 != 1 else 1 - y) for d, _, y in rows]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    learnt = toxicity.training_rows(documents([(d, t) for d, t, _ in rows]), labels)
    assert len(learnt) == sum(zlib.crc32(str(d).encode()) % 3 != 1 for d, *_ in rows)
    truth = {t: y for _, t, y in rows}
    assert all(truth[r.text] == r.toxic for r in learnt.itertuples())


def test_query_shape_and_edges(spark, documents):
    labels = spark.createDataFrame([(2, 1, 0), (7, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(documents(EDGES), labels).collect()
    assert len(got) == len(EDGES)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1)
    assert toxicity.toxicity(documents([]), labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(documents(EDGES), none).collect()} == {0}
