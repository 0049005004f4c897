from collections import defaultdict

import pytest

from larder.llm import mixing
from tests.llm import brute
from tests.llm.conftest import EDGES, prose


def targets(sizes):
    """{source: target} by sharing again until no target is above three times its size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        if not open_:
            return {s: 3.0 * sizes[s] for s in order}
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def corpus():
    rows, at = [], 0
    for s, (n, words) in {"b": (40, 120), "a": (10, 30), None: (15, 60), "é": (300, 40), "z": (2, 3), "": (25, 90)}.items():
        for i in range(n):
            rows.append((at, prose(words + i % 7, at), s))
            at += 1
    return rows


def test_targets_and_takes(documents):
    rows = corpus()
    got = mixing.mix(documents(rows)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for d, t, s in rows:
        sizes[s] += len(brute.words(t))
    want = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= mixing.BLOCK_WORDS
    again = mixing.mix(documents(rows, partitions=7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_many_shards(documents, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 20)
    rows = corpus()
    got = mixing.mix(documents(rows)).collect()
    taken, want = defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        want[r["source"]] = r["target"]
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + mixing.BLOCK_WORDS


def test_apportionment_by_highest_quotients(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.4, "e": 8.6}
    df = spark.createDataFrame([(k, v, 100) for k, v in votes.items()], "key string, votes double, blocks long")
    got = {r["key"]: r["quota"] for r in mixing.apportion(df).collect()}
    quotients = sorted(((v / (2 * k + 1), s) for s, v in votes.items() for k in range(300)), reverse=True)
    want = defaultdict(int)
    for _, s in quotients[: round(sum(votes.values()))]:
        want[s] += 1
    assert got == {s: want[s] for s in votes}


def test_equal_quotients_deal_the_whole_house(spark):
    df = spark.createDataFrame([(c, 2.5, 10) for c in "abcd"], "key string, votes double, blocks long")
    got = [r["quota"] for r in mixing.apportion(df).orderBy("key").collect()]
    assert sum(got) == 10 and sorted(got) == [2, 2, 3, 3]


def test_edges(documents):
    got = mixing.mix(documents([(d, t, None if d == 7 else "s") for d, t in EDGES])).collect()
    assert len(got) == len(EDGES)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(documents([])).count() == 0
    assert [r["taken"] for r in mixing.mix(documents([(1, None)])).collect()] == [0]


def test_mixed_documents(documents):
    rows = [(1, prose(10, 1), "a"), (2, prose(500, 2), "b"), (3, None, "a")]
    df = documents(rows)
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(1) == 3 and ids.count(2) == 1 and 3 not in ids


def test_mixed_documents_without_ids(documents):
    """Rows without an id are taken by their own source and size."""
    a, b = prose(10, 1), prose(500, 2)
    got = [r["text"] for r in mixing.mixed_documents(documents([(None, a, "a"), (None, b, "b")])).collect()]
    assert got.count(a) == 3 and got.count(b) == 1
