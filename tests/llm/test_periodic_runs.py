import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import periodic_runs
from larder.llm.cover_lce import COVER, PERIOD, CoverLce
from tests.llm.brute import words
from tests.llm.conftest import EDGES, prose


def brute_runs(w):
    """Every maximal stretch with period q, by all starts; least period only."""
    out = set()
    n = len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            out.add((i, j + q - i, q))
            i = j + 1
    runs = []
    for s, m, q in sorted(out):
        smaller = any(all(w[s + t] == w[s + t + d] for t in range(m - d)) for d in range(1, q))
        if m >= max(24, 3 * q) and not smaller:
            runs.append((s, m, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def brute_alter(doc_id, w):
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    w = brute_alter(doc_id, words(text))
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = None
    for s, m, q in runs:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    short = " ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(short.encode()).hexdigest())


def found(texts):
    """Runs of texts of numbers, by the operator."""
    first = np.cumsum([0, *map(len, texts)])
    x = np.array([v for t in texts for v in t], np.int64)
    runs = periodic_runs.find_runs(x, first) if len(x) else periodic_runs.Runs(*[np.empty(0, np.int64)] * 4)
    out = [[] for _ in texts]
    for t, *r in zip(*(c.tolist() for c in (runs.text, runs.start, runs.length, runs.period))):
        out[t].append(tuple(r))
    return out


def test_cover_holds_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=0, max_size=400), st.integers(1, 90))
def test_extensions(values, block):
    x = np.array((values + values[:block]) * 2 + [9], np.int64)
    lce = CoverLce(x)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, len(x), (2, 200))
    a, b = a[a != b], b[a != b]
    for i, j, n in zip(a.tolist(), b.tolist(), lce.extend(a, b).tolist()):
        k = 0
        while max(i, j) + k < len(x) and x[i + k] == x[j + k]:
            k += 1
        assert n == k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.integers(1, 20), st.lists(st.integers(0, 3), max_size=6)), max_size=4))
def test_runs_of_repetitive_sequences(parts):
    texts = [block * times + tail for block, times, tail in parts]
    texts += [sum(texts, [])]
    assert found(texts) == [brute_runs(t) for t in texts]


def test_every_period_and_place():
    rng = random.Random(2)
    texts = []
    for q in range(1, 40):
        for _ in range(4):
            block = [rng.randrange(50) for _ in range(q)]
            m = max(24, 3 * q) + rng.randint(-2, 3)
            lead, tail = ([rng.randrange(50) for _ in range(rng.randint(0, 60))] for _ in range(2))
            texts.append(lead + [block[i % q] for i in range(m)] + tail)
    assert found(texts) == [brute_runs(t) for t in texts]


def test_fibonacci_and_binary_words():
    a, b = [0], [0, 1]
    for _ in range(10):
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(512)]
    texts = [b, thue, [0] * 700, [0, 1] * 300 + [0], ([0] * 30 + [1]) * 20]
    assert found(texts) == [brute_runs(t) for t in texts]


def test_one_long_text():
    rng = random.Random(3)
    block = [rng.randrange(1000) for _ in range(7_000)]
    text = [rng.randrange(1000) for _ in range(500)] + block * 4 + block[:123] + [1001]
    assert found([text]) == [[(500, 28_123, 7_000)]]
    assert found([[5] * 60_000]) == [[(0, 60_000, 1)]]


@pytest.fixture
def rows():
    out = [(d, t) for d, t in EDGES if d != 7] + [(100 + i, prose(40 + 7 * i, i)) for i in range(60)]
    out += [(200 + i, " ".join([prose(3 + i, i)] * 9) + "\n" + prose(30, i)) for i in range(12)]
    return out + [(None, "la " * 40), (300, "x " * 23), (301, "x " * 24)]


def test_digests_equal_brute_force(spark, documents, rows):
    got = [tuple(r) for r in periodic_runs.digests(documents(rows)).collect()]
    assert sorted(got, key=str) == sorted((brute_row(d, t) for d, t in rows), key=str)
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows if d is not None)


def test_runs_and_collapsed_texts(spark, documents):
    rows = [(1, "a b " * 30 + "c"), (2, None), (3, "plain words")]
    assert [tuple(r) for r in periodic_runs.runs(documents(rows)).collect()] == [(1, 0, 60, 2)]
    assert sorted(tuple(r) for r in periodic_runs.collapsed(documents(rows)).collect()) == [(1, "a b c"), (2, ""), (3, "plain words")]


def test_empty_table(spark, documents):
    assert periodic_runs.digests(documents([]).limit(0)).collect() == []
