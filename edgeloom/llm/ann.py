"""Nearest neighbours by cosine as a block matrix join of int8 tiles.

Unit vectors are rounded to eight bits with a scale of their own, and what the
rounding loses is known exactly for each vector. A tile multiplies a block of
queries with a block of rows in int8; the true cosine lies within
``e_q + e_o·(1 + e_q)`` of the product. Rows whose upper bound stays below the
k-th best lower bound of their tile are out; the others are computed again in
double precision on the original vectors, and heaps merge the tiles' results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import Scratch, query, read
from edgeloom.llm.knn_join import matrix
from edgeloom.llm.vectors import QUERY_STEP, of_one_length, usable

K = 5
QUERY_BLOCK, ROW_BLOCK = 1024, 8192


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(int8 values, scale, norm of what is lost)`` of the unit vectors along ``x``."""
    top = np.abs(x).max(axis=1, keepdims=True)
    unit = x / top
    unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    eight = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((unit - scale[:, None] * eight) ** 2).sum(axis=1))
    return eight, scale, lost + 1e-12


def tile(q8: np.ndarray, o8: np.ndarray) -> np.ndarray:
    """Integer products; single precision holds them exactly up to 2^24."""
    if q8.shape[1] * 127 * 127 < 1 << 24:
        return q8.astype(np.float32) @ o8.astype(np.float32).T
    return q8.astype(np.float64) @ o8.astype(np.float64).T


def in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products added up from the first component to the last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return in_turn(a, b) / (np.sqrt(in_turn(a, a)) * np.sqrt(in_turn(b, b)))


def tile_best(q: np.ndarray, q_id: np.ndarray, o: np.ndarray, o_id: np.ndarray, k: int) -> list[tuple[int, float, int]]:
    """``(query id, cosine, row id)``: the k nearest of each query within the tile."""
    (q8, qs, qe), (o8, os_, oe) = rounded(q), rounded(o)
    near = tile(q8, o8).astype(np.float64) * qs[:, None] * os_[None, :]
    bound = qe[:, None] + oe[None, :] * (1 + qe[:, None])
    own = q_id[:, None] == o_id[None, :]
    low = np.where(own, -np.inf, near - bound)
    if low.shape[1] > k:
        at_least = np.partition(low, -k, axis=1)[:, -k]
    else:
        at_least = np.full(len(q), -np.inf)
    i, j = np.nonzero((near + bound >= at_least[:, None]) & ~own)
    heaps: dict[int, list] = {}
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        for n, score, row in zip(q_id[a].tolist(), cosine(q[a], o[b]).tolist(), o_id[b].tolist(), strict=True):
            heap = heaps.setdefault(n, [])
            if len(heap) < k:
                heapq.heappush(heap, (score, -row))
            elif (score, -row) > heap[0]:
                heapq.heapreplace(heap, (score, -row))
    return [(n, score, -row) for n, heap in heaps.items() for score, row in heap]


def block_search(table: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest by cosine of every step-th row by id.

    All rows are searched and the bounds are safe, so the recall is 1. See
    ``usable`` for the rows that take part; zero vectors do not. An empty table
    or a single row has no result; fewer than k candidates are all returned.
    """
    scratch = Scratch(table.sparkSession)
    rows = scratch.keep(of_one_length(scratch.keep(usable(table, zero_ok=False))))
    kind = rows.schema["v"].dataType.simpleString()
    total = rows.count()
    asked = rows.filter(F.col("vec_id") % step == 0).count()
    across, down = max(1, -(-total // ROW_BLOCK)), max(1, -(-asked // QUERY_BLOCK))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            asks = np.flatnonzero(ids % step == 0)
            everyone = np.arange(len(ids))
            parts = (
                (np.repeat(asks, across), np.repeat(mixed[asks] % np.uint64(down), across), np.tile(np.arange(across), len(asks)), True),
                (np.repeat(everyone, down), np.tile(np.arange(down), len(ids)), np.repeat(mixed % np.uint64(across), down), False),
            )
            for row, y, x, role in parts:
                for at in range(0, len(row), 20_000):
                    c = slice(at, at + 20_000)
                    take = pa.array(row[c])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(y[c].astype(np.int32)), pa.array(x[c].astype(np.int32)), pa.array(np.full(len(take), role)), batch.column(0).take(take), batch.column(1).take(take)],
                        names=["y", "x", "asks", "vec_id", "v"],
                    )

    def solve(cell: pa.Table) -> pa.Table:
        v, ids, asks = matrix(cell.column("v")), cell.column("vec_id").to_numpy(), cell.column("asks").to_numpy(zero_copy_only=False)
        got = tile_best(v[asks], ids[asks], v[~asks], ids[~asks], k) if asks.any() and not asks.all() else []
        columns = list(zip(*got, strict=True)) or [[], [], []]
        return pa.table(
            {"query_id": pa.array(columns[0], pa.int64()), "score": pa.array(columns[1], pa.float64()), "vec_id": pa.array(columns[2], pa.int64())}
        )

    found = (
        rows.select("vec_id", "v")
        .mapInArrow(blocks, f"y int, x int, asks boolean, vec_id long, v {kind}")
        .groupBy("y", "x")
        .applyInArrow(solve, "query_id long, score double, vec_id long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM e),
s AS (SELECT q.vec_id AS query_id, o.vec_id AS vec_id, list_inner_product(q.v, o.v) / (q.norm * o.norm) AS score
  FROM n q JOIN n o ON q.vec_id <> o.vec_id WHERE q.vec_id % 50 = 0 AND q.norm > 0 AND o.norm > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op5_int8_block_neighbours", SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors by cosine of every fiftieth vector."""
    return block_search(read(spark, sf_dir, "embeddings"))
