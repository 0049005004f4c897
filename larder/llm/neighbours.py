"""Approximate nearest neighbours by shifted Hilbert curves.

Each of CURVES curves runs through its own random projection of the vectors to DIMENSIONS
coordinates, cut into equal shares and shifted, and orders all vectors. The order is
range-partitioned into BLOCKS blocks; a query looks at its block and REACH blocks on either
side, on every curve, and ranks what it meets by the exact distance of the original vectors.

Cuts and block edges come from a bounded sample (SAMPLE_ROWS of least hash); all rows are
indexed. A query meets (2 * REACH + 1) / BLOCKS of all rows on a curve: vectors without
low-dimensional structure need that much, see the README for the recall. Blocks are cut
into tiles of at most TILE_ROWS rows and TILE_QUERIES queries, however full they are.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part. Of rows with one vec_id the least vector counts; a null vec_id
takes no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.hilbert import hilbert_keys
from larder.llm.staging import staged

CURVES = 12
DIMENSIONS = 8
BITS = 5
BLOCKS = 32
REACH = 2
SEED = 11
SAMPLE_ROWS = 20_000
# A block holds at least this many sampled rows.
BLOCK_SAMPLE = 64
TILE_ROWS = 16_000
TILE_QUERIES = 2_000
_AT_ONCE = 256


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector): one row per vec_id that takes part."""
    good = vectors.filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0)
    )
    lengths = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = good.filter(F.size("embedding") == (lengths["n"] if lengths else 0))
    return good.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("vector"))


@dataclass
class Curves:
    """Per curve: projection, cuts of every coordinate, shifts, and block edges."""

    projections: list[np.ndarray]
    cuts: list[np.ndarray]
    shifts: list[np.ndarray]
    edges: list[np.ndarray]

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        """Places on a curve. Coordinates become shares of the sample, shifted within half a grid."""
        grid = np.empty((len(x), self.projections[curve].shape[1]), np.int64)
        flat = x @ self.projections[curve]
        for i, cuts in enumerate(self.cuts[curve]):
            share = np.searchsorted(cuts, flat[:, i], side="right") / (len(cuts) + 1)
            grid[:, i] = (share + self.shifts[curve][i]) / 1.5 * (1 << BITS)
        return hilbert_keys(grid, BITS)

    def blocks(self, x: np.ndarray) -> np.ndarray:
        """Block number of each row on each curve."""
        return np.column_stack([np.searchsorted(e, self.keys(x, c), side="right") for c, e in enumerate(self.edges)])


def fit(sample: np.ndarray) -> Curves:
    draw = np.random.default_rng(SEED)
    curves = Curves([], [], [], [])
    width = sample.shape[1]
    for c in range(CURVES):
        axes, _ = np.linalg.qr(draw.normal(size=(width, width)))
        curves.projections.append(axes[:, :DIMENSIONS])
        flat = sample @ curves.projections[c]
        curves.cuts.append(np.quantile(flat, np.linspace(0, 1, 257)[1:-1], axis=0).T)
        curves.shifts.append(draw.random(flat.shape[1]) * 0.5)
        keys = np.sort(curves.keys(sample, c))
        blocks = max(1, min(BLOCKS, len(sample) // BLOCK_SAMPLE))
        curves.edges.append(np.unique(keys[[len(keys) * i // blocks for i in range(1, blocks)]]))
    return curves


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _indexed(curves: Curves) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2_000) for i in range(0, len(batch), 2_000)):
                found = curves.blocks(_matrix(part.column(1))).astype(np.int32)
                at = pa.array(np.arange(len(part) + 1) * CURVES, pa.int32())
                yield pa.record_batch([*part.columns, pa.ListArray.from_arrays(at, pa.array(found.ravel()))], ["vec_id", "vector", "blocks"])

    return run


def nearest_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, row ids, distances) of the k nearest rows, ties to the smaller id, exactly."""
    square = (rows**2).sum(axis=1)
    for at in range(0, len(queries), _AT_ONCE):
        q, own = queries[at : at + _AT_ONCE], query_ids[at : at + _AT_ONCE]
        near = square[None, :] - 2 * (q @ rows.T) + (q**2).sum(axis=1)[:, None]
        near[own[:, None] == ids[None, :]] = np.inf
        limit = np.partition(near, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
        # The product form rounds; what might still be among the k is measured again.
        slack = 1e-9 * (square.max() + (q**2).sum(axis=1))
        i, j = np.nonzero((near <= (limit + slack)[:, None]) & np.isfinite(near))
        distance = np.sqrt(((q[i] - rows[j]) ** 2).sum(axis=1))
        order = np.lexsort((ids[j], distance, i))
        i, j, distance = i[order], j[order], distance[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        yield own[i[keep]], ids[j[keep]], distance[keep]


def _rerank(k: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy()
        ids = table.column("vec_id").to_numpy()
        found = []
        if asks.any() and not asks.all():
            x = _matrix(table.column("vector").combine_chunks())
            found = list(nearest_of(ids[asks], x[asks], ids[~asks], x[~asks], k))
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        q, v, d = (np.concatenate(c) for c in zip(*(found or [empty])))
        return pa.table({"query_id": q, "vec_id": v, "score": d})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that is_query holds for."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = staged(valid_vectors(vectors), "ann-vectors")
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE_ROWS).select("vector").toPandas()
    if len(sample) < 2:
        return spark.createDataFrame([], schema)
    curves = fit(np.stack(sample["vector"]).astype(np.float64))
    kind = dict(rows.dtypes)["vector"]
    indexed = staged(
        rows.mapInArrow(_indexed(curves), f"vec_id long, vector {kind}, blocks array<int>").withColumn("asks", is_query), "ann-index"
    )
    placed = indexed.select("vec_id", "vector", "asks", F.posexplode("blocks").alias("curve", "block"))
    # At most CURVES * BLOCKS rows, whatever the number of vectors.
    counts = placed.groupBy("curve", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("asking")).collect()
    full = {(r["curve"], r["block"]): (r["n"], r["asking"]) for r in counts}
    tiles = []
    for (curve, block), (n, _) in full.items():
        asking = sum(full.get((curve, block + d), (0, 0))[1] for d in range(-REACH, REACH + 1))
        tiles.append((curve, block, -(-n // TILE_ROWS), max(1, -(-asking // TILE_QUERIES))))
    tiles = F.broadcast(spark.createDataFrame(tiles, "curve int, block int, row_parts int, query_parts int"))

    own = F.xxhash64("vec_id")
    candidates = placed.join(tiles, ["curve", "block"]).select(
        "curve", "block", "vec_id", "vector", F.lit(False).alias("asks"), F.pmod(own, "row_parts").cast("int").alias("row_part"),
        F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("query_part"),
    )
    around = F.explode(F.sequence(F.col("block") - REACH, F.col("block") + REACH))
    queries = placed.filter("asks").select("curve", around.alias("block"), "vec_id", "vector").join(tiles, ["curve", "block"]).select(
        "curve", "block", "vec_id", "vector", F.lit(True).alias("asks"),
        F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1)).alias("row_part"), F.pmod(own, "query_parts").cast("int").alias("query_part"),
    )
    met = candidates.unionByName(queries).groupBy("curve", "block", "row_part", "query_part").applyInArrow(
        _rerank(k), "query_id long, vec_id long, score double"
    )
    best = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
