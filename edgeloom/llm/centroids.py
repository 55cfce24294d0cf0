"""Centroid clustering in whole numbers by progressive search in the Walsh-Hadamard domain.

Vectors and centroids are transformed exactly: 64 sums and differences of their
components, ordered from the coarsest (fewest sign changes) to the finest. The
transform keeps squared distances up to the factor 64, so squared differences of
coefficients may be added up block by block, and what is added so far is a lower
bound. After the first block the centroid that leads gets its whole distance; a
centroid whose sum is strictly above that is out. Those that are left are
carried through all 64 coefficients.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import Scratch, query, read

SIZE = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = "3"
#: Coefficients after which sums are compared with the leader's distance.
STEPS = (4, 8, 16, 32, 64)
#: Coefficients below this leave room for sums of squares in 64 bits; larger ones take Python's integers.
SMALL = 1 << 26


def hadamard(size: int) -> np.ndarray:
    """Orthogonal rows of +1 and -1."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h


def coarse_first(size: int) -> np.ndarray:
    """Rows of ``hadamard`` by rising number of sign changes."""
    return np.argsort((np.diff(hadamard(size), axis=1) != 0).sum(axis=1), kind="stable")


def transform(rows: np.ndarray) -> np.ndarray:
    """Coefficients of integer vectors, coarse to fine, by rounds of sums and differences."""
    n, size = rows.shape
    out, half = rows, 1
    while half < size:
        pairs = out.reshape(n, size // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return out[:, coarse_first(size)]


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each point and 64 times the squared distance, both given by coefficients.

    Ties go to the smaller number. Also the number of coefficient differences taken.
    """
    largest = max(int(abs(points).max(initial=0)), int(abs(centroids).max(initial=0)))
    if largest >= SMALL:
        points, centroids = points.astype(object), centroids.astype(object)
    n, k = len(points), len(centroids)
    row, which = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    added = np.zeros(n * k, points.dtype)
    taken, done, limit = 0, 0, None
    for step in STEPS:
        gap = points[:, done:step][row] - centroids[:, done:step][which]
        added = added + (gap * gap).sum(axis=1)
        taken += gap.size
        done = step
        if limit is None:
            rest = points - centroids[added.reshape(n, k).argmin(axis=1)]
            limit = (rest * rest).sum(axis=1)
            taken += rest.size
        stay = added <= limit[row]
        row, which, added = row[stay], which[stay], added[stay]
    # Whole distances now, at most the leader's: the least of them first, of equals the smaller number.
    order = np.lexsort((which, added, row))
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    return which[first], added[first], taken


def integers(embedding: pa.Array, scale: int, size: int) -> np.ndarray:
    """floor(scale * x) of every component, ``size`` a row; Python's integers where 64 bits are too few."""
    x = np.floor(embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, size)
    if np.abs(x).max(initial=0) < 2**52:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(-1, size)


def coefficients(table: DataFrame, vec_id: str, embedding: str, scale: int, size: int) -> DataFrame:
    """``(vec_id, c)`` of the rows that are kept; a coefficient beyond 64 bits is an error."""
    kind = table.schema[vec_id].dataType.simpleString()
    v = F.col(f"`{embedding}`").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = table.filter(v.isNotNull() & (F.size(v) == size) & ~odd).select(F.col(f"`{vec_id}`").alias("vec_id"), v.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = transform(integers(batch.column(1), scale, size)).ravel()
                flat = pa.array(found.tolist() if found.dtype == object else found, pa.int64())
                ends = pa.array(np.arange(0, len(flat) + 1, size), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=["vec_id", "c"])

    return kept.mapInArrow(run, f"vec_id {kind}, c array<long>")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def original(total: np.ndarray) -> np.ndarray:
    """Sums of the vectors from the sums of their coefficients: the transform is its own inverse up to ``size``."""
    h = hadamard(len(total))[coarse_first(len(total))].astype(object)
    return (h.T @ total) // len(total)


def round_of(points: DataFrame, centroids: np.ndarray, size: int) -> dict[int, tuple[int, np.ndarray]]:
    """Per cluster its number of vectors and the sum of their coefficients: one row a task and cluster comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), size), object)
        for batch in batches:
            if batch.num_rows:
                c = matrix(batch.column(0), size)
                which, _, _ = nearest(c, centroids)
                few = np.abs(c).max() < (1 << 62) // max(1, len(c))
                for i in np.unique(which).tolist():
                    mine = c[which == i]
                    count[i] += len(mine)
                    total[i] += (mine if few else mine.astype(object)).sum(axis=0)
        got = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array(got, pa.int64()),
                "n": pa.array(count[got]),
                "total": pa.array([[str(x) for x in total[i]] for i in got.tolist()], pa.list_(pa.string())),
            }
        )

    parts = points.select("c").mapInArrow(run, "cluster long, n long, total array<string>")
    sums = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(size)]
    )
    return {r["cluster"]: (r["n"], np.array([int(r[f"t{i}"]) for i in range(size)], object)) for r in sums.collect()}


def narrow(rows: np.ndarray) -> np.ndarray:
    """64-bit integers where they do."""
    return rows.astype(np.int64) if max((abs(int(x)) for x in rows.ravel()), default=0) < 1 << 62 else rows


def cluster(
    table: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    size: int = SIZE,
    seed: str = SEED,
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept row.

    Kept are rows whose vector has exactly ``size`` components (a power of two),
    none null or not finite. The first centroids are the ``clusters`` kept rows
    with the smallest sha256 of ``seed:vec_id`` (ties: the smaller coefficients;
    a null vec_id comes last), as many as there are if fewer. Every row counts,
    rows that repeat an id or a vector too; an empty table gives no rows. Other
    columns are not read. Numbers are exact at any size: a coefficient or a
    distance that does not fit a long is an error, never a wrong value.
    """
    scratch = Scratch(table.sparkSession)
    points = scratch.keep(coefficients(table, vec_id, embedding, scale, size))
    rank = F.sha2(F.concat(F.lit(seed + ":"), F.col("vec_id").cast("string")), 256)
    seeds = points.select(rank.alias("h"), "c").orderBy(F.asc_nulls_last("h"), "c").limit(clusters).collect()
    shape = f"vec_id {points.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    centroids = np.array([r["c"] for r in seeds], np.int64).reshape(-1, size)
    for _ in range(rounds if len(seeds) else 0):
        found = round_of(points, centroids, size)
        means = [original(found[i][1]) // found[i][0] if i in found else None for i in range(len(centroids))]
        moved = [transform(m.reshape(1, -1))[0] if m is not None else centroids[i] for i, m in enumerate(means)]
        moved = narrow(np.array([list(map(int, m)) for m in moved], object))
        if (moved == centroids).all():
            break  # later rounds would repeat this one
        centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                which, far, _ = nearest(matrix(batch.column(1), size), centroids)
                out = [batch.column(0), pa.array(which, pa.int32()), pa.array([int(x) // size for x in far], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["vec_id", "cluster", "distance"])

    told = scratch.keep(points.mapInArrow(run, shape))
    scratch.drop(points)
    each = told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    inertia = {r["cluster"]: int(r["d"]) for r in each}
    plain = [(original(np.array([int(x) for x in c], object))).tolist() for c in centroids]
    rows = [
        (i, inertia[i], sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(plain)
        if i in inertia
    ]
    facts = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def twin() -> str:
    """SQL of the query: rounds one after the other, distances component by component."""
    odd = "list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))"
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS x
  FROM embeddings WHERE len(embedding) = {SIZE} AND len({odd}) = 0),
e AS MATERIALIZED (SELECT r, unnest(range({SIZE})) AS d, unnest(x) AS x FROM v),
s AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR) NULLS LAST) - 1 AS c, x FROM v),
c0 AS MATERIALIZED (SELECT c, unnest(range({SIZE})) AS d, unnest(x) AS y FROM s WHERE c < {CLUSTERS})"""
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT r, min_by(c, (far, c)) AS c, min(far) AS far FROM
  (SELECT r, c, sum((x - y) * (x - y))::HUGEINT AS far FROM e JOIN c{i} USING (d) GROUP BY r, c) GROUP BY r)"""
        )
        if i < ROUNDS:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c, d, coalesce(m, y) AS y FROM c{i} LEFT JOIN
  (SELECT c, d, (t - ((t % n) + n) % n) // n AS m FROM (SELECT c, d, sum(x)::HUGEINT AS t, count(*)::HUGEINT AS n FROM e JOIN a{i} USING (r) GROUP BY c, d))
  USING (c, d))"""
            )
    final = f"(SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS h FROM c{ROUNDS} GROUP BY c)"
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c::INT AS cluster, far::BIGINT AS distance, (sum(far) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(far) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN {final} USING (c)"""
    )


@query("op13_walsh_hadamard_clusters", twin())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors after ten rounds, in whole numbers."""
    return cluster(read(spark, sf_dir, "embeddings"))
