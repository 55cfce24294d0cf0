"""Exact top-k by inner product as a Voronoi join.

Queries and data are grouped by their nearest pivot. What a query group needs
follows from summaries alone: with a query within R of its pivot p and a row o,
``|q·o − p·o| ≤ R·|o|``. The rows nearest each pivot give every query group a
score that k of its candidates certainly reach; a row goes to a query group
only if its upper bound reaches that. Queries far from every pivot cannot be
bounded and would spoil their group's radius: they form one group around the
origin. Groups are cut into bounded blocks, so a group that holds a third of
the rows is spread like the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import Scratch, query, read
from edgeloom.llm.vectors import QUERY_STEP, of_one_length, usable

K = 5
SCALE = 256
#: Pivots grow with the square root of the rows, up to this many.
MOST_PIVOTS = 256
#: A query is near its pivot within this share of the pivot's norm.
NEAR = 0.25
#: Queries and rows that meet in one task.
QUERY_BLOCK, ROW_BLOCK = 512, 8192


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal-length lists as a double matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


def best_rows(score: np.ndarray, ids: np.ndarray, k: int, never: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """``(query row, column)`` of each row's k largest, ties to the smaller id; ``never``, the least value, does not count."""
    at_least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), never, score.dtype)
    i, j = np.nonzero((score >= at_least[:, None]) & (score > never))
    order = np.lexsort((ids[j], -score[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k]


def pivots_of(rows: DataFrame, total: int) -> np.ndarray:
    """A bounded hashed sample of the quantised rows."""
    most = int(min(MOST_PIVOTS, max(4, total**0.5 / 8)))
    picked = rows.select(F.xxhash64("vec_id").alias("h"), "vec_id", "v").orderBy("h", "vec_id").limit(most).toArrow()
    return np.unique(quantised(matrix(picked.column("v"))), axis=0)


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d2 = (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    group = d2.argmin(axis=1)
    return group, np.sqrt(((x - pivots[group]) ** 2).sum(1))


def grouped(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``(vec_id, v, grp, dist, asks_in, reach)``: the nearest pivot and the distance to it; as a
    query, the group and the distance to its centre (the origin's group is the one after the pivots)."""
    norms = np.linalg.norm(pivots, axis=1)
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = quantised(matrix(batch.column(1)))
            group, dist = nearest(x, pivots)
            near = dist <= NEAR * norms[group]
            asks_in = np.where(near, group, len(pivots)).astype(np.int32)
            reach = np.where(near, dist, np.linalg.norm(x, axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(group.astype(np.int32)), pa.array(dist), pa.array(asks_in), pa.array(reach)],
                names=["vec_id", "v", "grp", "dist", "asks_in", "reach"],
            )

    return rows.select("vec_id", "v").mapInArrow(
        run, f"vec_id long, v {kind}, grp int, dist double, asks_in int, reach double"
    )


def floors(centres: np.ndarray, radius: np.ndarray, near: list[tuple[int, float]], k: int) -> np.ndarray:
    """A score that at least k candidates of any query of each group reach; ``radius`` is around ``centres``.

    ``near`` holds, for the k + 1 rows nearest each pivot, the group and the
    distance; one of them may be the query itself.
    """
    out = np.full(len(centres), -np.inf)
    if len(near) <= k:
        return out
    j, d = np.array([g for g, _ in near]), np.array([x for _, x in near])
    norms = np.linalg.norm(centres, axis=1)
    for i in range(len(centres)):
        low = centres[j] @ centres[i] - norms[i] * d - radius[i] * (norms[j] + d)
        out[i] = np.sort(low)[-(k + 1)] - 1e-6 * (1 + abs(norms[i]) * norms.max())
    return out


def knn_join(table: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best inner products of every step-th row by id.

    Scores are exact as long as they stay below 2^53 and wrap like a long beyond.
    See ``usable`` for the rows that take part. An empty table, or one with a
    single row, has no result; fewer than k candidates are all returned.
    """
    spark = table.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(of_one_length(scratch.keep(usable(table))))
    total = rows.count()
    pivots = pivots_of(rows, total)
    if not total:
        pivots = np.zeros((1, 1))
    kind = rows.schema["v"].dataType.simpleString()
    data = scratch.keep(grouped(rows, pivots))
    asked = F.col("vec_id") % step == 0
    # Summaries: bounded by the number of pivots.
    asking = data.filter(asked).groupBy("asks_in").agg(F.max("reach").alias("r"), F.count("*").alias("n"))
    summary = {r["asks_in"]: r for r in asking.collect()}
    centres = np.concatenate([pivots, np.zeros((1, pivots.shape[1]))])
    ranked = data.select("grp", "dist", "vec_id").withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy("dist", "vec_id")))
    near = [(r["grp"], r["dist"]) for r in ranked.filter(f"_r <= {k + 1}").collect()]
    radius = np.array([summary[g]["r"] if g in summary else 0.0 for g in range(len(centres))])
    blocks = np.array([-(-summary[g]["n"] // QUERY_BLOCK) if g in summary else 0 for g in range(len(centres))])
    floor = floors(centres, radius, near, k)
    slices = max(1, -(-total // ROW_BLOCK))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, groups = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            x = quantised(matrix(batch.column(1)))
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            row, grp, block, part, role = [], [], [], [], []
            is_query = np.flatnonzero(ids % step == 0)
            for g in np.unique(groups[is_query]):  # a query goes to every slice of its block
                own = is_query[groups[is_query] == g]
                row.append(np.repeat(own, slices))
                grp.append(np.full(len(own) * slices, g))
                block.append(np.repeat(mixed[own] % np.uint64(blocks[g]), slices).astype(np.int64))
                part.append(np.tile(np.arange(slices), len(own)))
                role.append(np.ones(len(own) * slices, bool))
            upper = x @ centres.T + np.linalg.norm(x, axis=1)[:, None] * radius[None, :]
            for g in np.flatnonzero(blocks):  # a row goes to the blocks that may need it
                own = np.flatnonzero(upper[:, g] * (1 + 1e-12) + 1e-6 >= floor[g])
                n = blocks[g]
                row.append(np.repeat(own, n))
                grp.append(np.full(len(own) * n, g))
                block.append(np.tile(np.arange(n), len(own)))
                part.append(np.repeat((mixed[own] % np.uint64(slices)).astype(np.int64), n))
                role.append(np.zeros(len(own) * n, bool))
            if not row:
                continue
            row, grp, block, part, role = map(np.concatenate, (row, grp, block, part, role))
            for at in range(0, len(row), 20_000):
                c = slice(at, at + 20_000)
                take = pa.array(row[c])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grp[c].astype(np.int32)), pa.array(block[c].astype(np.int32)), pa.array(part[c].astype(np.int32)), pa.array(role[c]), batch.column(0).take(take), batch.column(1).take(take)],
                    names=["grp", "block", "part", "asks", "vec_id", "v"],
                )

    def solve(cell: pa.Table) -> pa.Table:
        x, ids, asks = quantised(matrix(cell.column("v"))), cell.column("vec_id").to_numpy(), cell.column("asks").to_numpy(zero_copy_only=False)
        q, o, q_id, o_id = x[asks], x[~asks], ids[asks], ids[~asks]
        if len(q) and len(o):
            size = float(np.abs(q).max()) * float(np.abs(o).max()) * x.shape[1]
            if size >= 2**53:  # doubles would round
                q, o = q.astype(np.int64), o.astype(np.int64)
            never = -np.inf if size < 2**53 else np.iinfo(np.int64).min
            score = np.where(q_id[:, None] == o_id[None, :], never, q @ o.T)
            i, j = best_rows(score, o_id, k, never)
            return pa.table({"query_id": q_id[i], "vec_id": o_id[j], "score": score[i, j].astype(np.int64)})
        none = pa.array([], pa.int64())
        return pa.table({"query_id": none, "vec_id": none, "score": none})

    found = (
        data.mapInArrow(cells, f"grp int, block int, part int, asks boolean, vec_id long, v {kind}")
        .groupBy("grp", "block", "part")
        .applyInArrow(solve, "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
    )


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, o.vec_id AS vec_id, list_inner_product(q.v, o.v)::BIGINT AS score
  FROM e q JOIN e o ON q.vec_id <> o.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op2_voronoi_topk", SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best integer inner products of every fiftieth vector."""
    return knn_join(read(spark, sf_dir, "embeddings"))
