"""Seeded splits of multigraph edges, identical on every run and engine."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.keys import expand_copies, hash_bucket, text_hash
from edgeloom.session import pin

#: Edges in seeded order; the rest settles equal hashes.
ORDER = ["h", "src", "dst", "et", "copy"]


def hashed_edges(
    edges: DataFrame, keys: Sequence[str], seed: int, text: Callable[[str], Column] = F.col
) -> DataFrame:
    """Edges with a hash ``h`` of their seeded pseudo-random order.

    Parallel copies are numbered first, so each of them gets its own hash.
    ``text`` writes a node as it is hashed.
    """
    keys = list(keys)
    copies = pin(edges.groupBy(*keys, "src", "dst", "et").agg(F.count("*").alias("_copies")))
    return expand_copies(copies, "_copies", "copy").withColumn(
        "h", text_hash(F.lit(seed), *keys, text("src"), text("dst"), "et", "copy")
    )


def edges_at(rows: DataFrame, keys: Sequence[str], places: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """``(keys…, names…)``: the edge at some places of each graph's order, as a struct of ``ORDER``.

    ``places`` gives them from the graph's size.  Hash prefixes are counted to
    find the ones the places are in, and only these few edges are sorted.
    """
    keys = list(keys)
    bucket = hash_bucket("h")
    sizes = rows.groupBy(*keys, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sizes.withColumns({"_end": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    wanted = places(F.col("_all"))
    cuts = F.inline(F.array(*[F.struct(F.lit(n).alias("_name"), c.cast("long").alias("_at")) for n, c in wanted.items()]))
    held = pin(
        ends.select(*keys, "_bucket", "_n", "_end", cuts)
        .filter((F.col("_at") <= F.col("_end")) & (F.col("_at") > F.col("_end") - F.col("_n")))
        .select(*keys, "_bucket", "_name", (F.col("_at") - F.col("_end") + F.col("_n")).alias("_at"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*ORDER)
    near = (
        rows.withColumn("_bucket", bucket)
        .join(held.select(*keys, "_bucket").distinct(), [*keys, "_bucket"], "left_semi")
        .withColumn("_place", F.row_number().over(inside))
    )
    found = near.join(held, [*keys, "_bucket"]).filter("_place = _at")
    return pin(
        found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.struct(*ORDER))).alias(n) for n in wanted])
    )


def _labelled(
    edges: DataFrame, keys: list[str], seed: int, places: Callable[[Column], dict[str, Column]], last: str,
    text: Callable[[str], Column] = F.col,
) -> DataFrame:
    """Edges with ``split``: the first name whose place is not before them, else ``last``."""
    rows = hashed_edges(edges, keys, seed, text)
    cuts = edges_at(rows, keys, places)
    names = [c for c in cuts.columns if c not in keys]
    own = F.struct(*ORDER)
    label = F.coalesce(*[F.when(own <= F.col(f"_{n}"), n) for n in names], F.lit(last))
    renamed = cuts.select(*keys, *[F.col(n).alias(f"_{n}") for n in names])
    return rows.join(renamed, keys).select(*keys, "src", "dst", "et", "copy", label.alias("split"))


def mask_split(
    edges: DataFrame, keys: Sequence[str], ratio: float = 0.2, seed: int = 42, text: Callable[[str], Column] = F.col
) -> DataFrame:
    """``split`` = test for max(1, ⌊n·ratio⌋) edges of each graph, else train."""
    if not 0.0 < ratio < 1.0:
        raise ValueError(f"ratio must be in (0, 1), got {ratio}")
    return _labelled(
        edges, list(keys), seed, lambda n: {"test": F.greatest(F.lit(1), F.floor(n * ratio))}, "train", text
    )


def kg_split(
    edges: DataFrame, keys: Sequence[str], seed: int = 42, hidden_ratio: float = 0.1
) -> DataFrame:
    """hidden / train / val / test labels: a hidden share, then 80/10/10 of the rest."""
    if not 0.0 < hidden_ratio < 1.0:
        raise ValueError(f"hidden_ratio must be in (0, 1), got {hidden_ratio}")

    def places(n: Column) -> dict[str, Column]:
        hidden = F.greatest(F.lit(1), F.bround(n * hidden_ratio).cast("long"))
        tenth = F.bround((n - hidden) * 0.1).cast("long")
        return {"hidden": hidden, "train": n - 2 * tenth, "val": n - tenth}

    return _labelled(edges, list(keys), seed, places, "test")


def train_graph(split_edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The training edges alone; the entity table stays whole."""
    return split_edges.filter(F.col("split") == "train").select(*keys, "src", "dst", "et")
