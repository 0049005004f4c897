import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import neighbours
from larder.llm.hilbert import hilbert_keys
from tests.conftest import SF


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)


def search(spark, rows, every=1, k=10):
    found = neighbours.nearest(frame(spark, rows), F.col("vec_id") % every == 0, k).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def plain(rows, query, k=10):
    q = np.float32(dict(rows)[query]).astype(float)
    near = sorted((math.sqrt(((q - np.float32(v).astype(float)) ** 2).sum()), i) for i, v in rows if i != query)
    return [(n + 1, i, d) for n, (d, i) in enumerate(near[:k])]


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_each_cell_and_steps_to_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    got = search(spark, rows, 10)
    assert got.keys() == {0, 10, 20, 30}
    for q in got:
        want = plain(rows, q)
        assert [x[:2] for x in got[q]] == [x[:2] for x in want]
        assert [x[2] for x in got[q]] == pytest.approx([x[2] for x in want])


def test_recall_on_the_test_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = search(spark, rows, 20)
    hits = [len({x[1] for x in got[q]} & {x[1] for x in plain(rows, q)}) for q in got]
    assert sum(hits) >= 0.9 * 10 * len(hits)


def test_ties_and_copies_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 7)
    monkeypatch.setattr(neighbours, "TILE_QUERIES", 3)
    rows = [(i, [1.0, 2.0, 0.0]) for i in range(30)] + [(100 + i, [float(i), 0.0, 1.0]) for i in range(5)]
    got = search(spark, rows)
    for q in range(30):
        assert [x[1] for x in got[q]] == [i for i in range(11) if i != q][:10]
        assert [x[2] for x in got[q]] == [0.0] * 10


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (7, [1.0, 2.0, 3.0]), (8, []), (None, [1.0, 0.0]), (1, [2.0, 1.0])]
    assert search(spark, rows) == {0: [(1, 1, 1.0)], 1: [(1, 0, 1.0)]}


def test_empty_table_and_single_row(spark):
    assert search(spark, []) == {}
    assert search(spark, [(0, [1.0])]) == {}
