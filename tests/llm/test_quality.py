import collections

import numpy as np
import pytest

from larder.llm import quality
from tests.llm import brute
from tests.llm.conftest import EDGES, prose


def plain(text):
    w, seen, dup = brute.words(text), set(), 0
    for line in (text or "").split("\n"):
        if brute.words(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(cover)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def junk(i):
    return " ".join(f"{w}###" for w in prose(80, i).split())


def test_counts_and_verdicts(spark, documents):
    rows = [(i, prose(80, i)) for i in range(60)] + [(100 + i, junk(i)) for i in range(60)]
    rows += [(300, prose(10, 1)), (301, "a b c " * 30), (302, "x y\n\nx y\nx y \n  \n" * 20)]
    known = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)]
    got = {r["doc_id"]: r for r in quality.verdicts(documents(rows), labels(spark, known)).collect()}
    for d, text in rows:
        r, want = got[d], plain(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert all(got[i]["kept"] for i in range(60)) and not any(got[100 + i]["kept"] for i in range(60))
    assert [got[d]["base_failed"] for d in (300, 301, 302)] == [True, True, True]


def test_edges(spark, documents):
    got = quality.verdicts(documents(EDGES), labels(spark, [])).collect()
    assert len(got) == len(EDGES)
    for r in got:
        want = next(plain(t) for d, t in EDGES if d == r["doc_id"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["kept"] == (not r["base_failed"])


def test_kept_documents(spark, documents):
    df = documents([(1, prose(80, 1)), (2, prose(10, 2)), (3, None), (1, prose(80, 1))])
    kept = quality.kept_documents(df, labels(spark, [(9, 1, 0)]))
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1]
    assert quality.kept_documents(documents([]), labels(spark, [])).count() == 0


@pytest.mark.parametrize("direction", [1, -1])
def test_constrained_features_are_monotonic(direction):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=3000)) * 1.0 > 0).astype(float)
    forest = quality.train(x, y, (0, direction, 0))
    grid = np.repeat(x[:50], 40, axis=0)
    grid[:, 1] = np.tile(np.linspace(-4, 4, 40), 50)
    steps = np.diff(forest.margin(grid).reshape(50, 40), axis=1)
    assert (direction * steps >= -1e-9).all()
    free = quality.train(x, y, (0, 0, 0))
    assert ((free.probability(x) > 0.5) == y).mean() > 0.75


def test_flat_arrays_equal_walking_the_trees():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(500, 4)), (rng.random(500) > 0.5).astype(float)
    f = quality.train(x, y, (0, 0, 0, 0))
    for row in x[:20]:
        total = f.bias
        for node in f.roots:
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
            total += f.value[node]
        assert total == pytest.approx(f.margin(row[None, :])[0])


@pytest.mark.parametrize("label", [0.0, 1.0])
def test_one_kind_of_label_keeps_everything(label):
    """Labels of one kind alone teach nothing, so the model rejects nothing."""
    x = np.random.default_rng(6).normal(size=(50, 9))
    assert (quality.train(x, np.full(50, label)).probability(x) >= quality.KEEP_FROM).all()
