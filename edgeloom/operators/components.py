"""Connected components by alternating large-star / small-star rounds.

First every task contracts the edges it holds, chunk by chunk, to the stars of
their own components.  Nodes that are no star's centre hang on their smallest
centre and leave; the rounds see the centres only.
The number of rounds grows with the logarithm of the graph, not its diameter.
Each round is two ``min`` aggregations (combined map-side) and the joins that
carry the minima back; AQE splits the join partition of a hub.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.session import pin

MAX_ROUNDS = 100
#: Edges that a task contracts at once.
CHUNK_EDGES = 1 << 19


def smallest_labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest node of every node's component, over edges among nodes 0 … n − 1."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        # A root that an edge connects to a smaller one takes it over for its whole tree.
        np.minimum.at(new, label[x], new[y])
        np.minimum.at(new, label[y], new[x])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """Numbers in the order of the values, and how many there can be; null is the last."""
    encoded = column.combine_chunks().dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = pc.fill_null(encoded.indices, len(order)).to_numpy(zero_copy_only=False)
    return np.append(rank, len(order))[at], len(order) + 1


def _contract(rows: pa.Table, keys: list[str]) -> pa.Table:
    """Edges ``(keys…, u, v)`` as the stars of their components, each around its smallest node."""
    n = rows.num_rows
    ends = pa.chunked_array([*rows["u"].chunks, *rows["v"].chunks])
    node, size = _codes(ends)
    for key in keys:
        code, more = _codes(rows[key])
        if more > 2 or rows[key].null_count:
            node, size = _codes(pa.chunked_array([pa.array(np.tile(code, 2) * size + node)]))
    first = np.empty(size, np.int64)
    first[node[::-1]] = np.arange(len(node) - 1, -1, -1)
    first = first[: int(node.max(initial=-1)) + 1]
    label = smallest_labels(len(first), node[:n], node[n:])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.table(
        [*[rows[key].take(first[moved] % n) for key in keys], ends.take(first[moved]), ends.take(first[label[moved]])],
        names=[*keys, "u", "v"],
    )


def contracted(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys…, u, v)`` with the same components and at most as many rows."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_EDGES:
                # What is left goes on into the next chunk unless it would fill it.
                small = _contract(pa.Table.from_batches(held), keys).combine_chunks()
                held, n = small.to_batches(), small.num_rows
                if n > CHUNK_EDGES // 2:
                    yield from held
                    held, n = [], 0
        if n:
            yield from _contract(pa.Table.from_batches(held), keys).combine_chunks().to_batches()

    edges = edges.select(*keys, "u", "v")
    return edges.mapInArrow(run, edges.schema)


def _is_star(star: DataFrame, keys: list[str]) -> bool:
    """Settled: every node points at one root, and no root points anywhere."""
    roles = star.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("root")),
                F.struct(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("root")),
            )
        ),
    )
    mixed = (
        roles.groupBy(*keys, "x")
        .agg(F.sum("out").alias("out"), F.max("root").alias("root"))
        .filter("out > 1 OR (out = 1 AND root = 1)")
    )
    return mixed.isEmpty()


def _large_star(star: DataFrame, keys: list[str]) -> DataFrame:
    both = star.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("u").alias("x"), F.col("v").alias("y")),
                F.struct(F.col("v").alias("x"), F.col("u").alias("y")),
            )
        ),
    )
    lowest = both.groupBy(*keys, "x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    return (
        both.filter("y > x")
        .join(lowest, [*keys, "x"])
        .select(*keys, F.col("y").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(star: DataFrame, keys: list[str]) -> DataFrame:
    down = star.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    return (
        down.join(lowest, [*keys, "u"])
        .select(
            *keys,
            F.inline(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            ),
        )
        .filter("u <> v")
        .distinct()
    )


def _centres_and_leaves(
    edges: DataFrame, keys: Sequence[str], src: str = "src", dst: str = "dst"
) -> tuple[DataFrame, DataFrame]:
    """Settled stars ``(keys…, u, v)`` of the centres, and every other node u with a centre v beside it.

    Contracted rows point to smaller nodes, so a component's smallest node is a centre.
    """
    keys = list(keys)
    rows = contracted(
        edges.filter(F.col(src) != F.col(dst)).select(*keys, F.col(src).alias("u"), F.col(dst).alias("v")), keys
    )
    # A node has a row per contracted chunk at most.
    rows = pin(rows.withColumn("m", F.min("v").over(Window.partitionBy(*keys, "u"))))
    centres = pin(rows.select(*keys, F.col("v").alias("u")).distinct())
    nearest = rows.filter("v = m").select(*keys, "u", "v").distinct()
    leaves = nearest.join(centres, [*keys, "u"], "left_anti")
    links = rows.filter("v > m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    star = pin(contracted(links.unionByName(nearest.join(centres, [*keys, "u"], "left_semi")), keys).distinct())
    for _ in range(MAX_ROUNDS):
        if _is_star(star, keys):
            return star, leaves
        star = pin(_small_star(_large_star(star, keys), keys))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def component_stars(
    edges: DataFrame, keys: Sequence[str], src: str = "src", dst: str = "dst"
) -> DataFrame:
    """``(keys…, u, v)``: every non-root node u with its component's smallest node v."""
    keys = list(keys)
    star, leaves = _centres_and_leaves(edges, keys, src, dst)
    roots = star.select(*keys, F.col("u").alias("v"), F.col("v").alias("_root"))
    hung = leaves.join(roots, [*keys, "v"], "left").select(*keys, "u", F.coalesce("_root", "v").alias("v"))
    return pin(star.unionByName(hung))


def forest_sizes(edges: DataFrame, keys: Sequence[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """``(keys…, n_forest)``: edges of a spanning forest, of graphs with any."""
    star, leaves = _centres_and_leaves(edges, keys, src, dst)
    return star.unionByName(leaves).groupBy(*keys).agg(F.count("*").alias("n_forest"))


def connected_components(
    nodes: DataFrame,
    edges: DataFrame,
    keys: Sequence[str],
    node: str = "id",
    src: str = "src",
    dst: str = "dst",
) -> DataFrame:
    """``(keys…, node, component)`` for every node; isolated nodes are their own."""
    keys = list(keys)
    star = component_stars(edges, keys, src, dst).select(
        *keys, F.col("u").alias(node), F.col("v").alias("_root")
    )
    return (
        nodes.select(*keys, node)
        .join(star, [*keys, node], "left")
        .select(*keys, node, F.coalesce("_root", node).alias("component"))
    )
