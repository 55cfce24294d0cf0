"""Best-per-cell archives, islands and top-k reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.keys import running_max, text_hash
from edgeloom.functions.numeric import clamp

CELL = ["row", "col"]


def grid_bin(value: Column, bins: int) -> Column:
    """A [0, 1] value as a bin index; 1.0 falls into the last bin."""
    if bins <= 0:
        raise ValueError("bins must be > 0")
    return F.least(F.lit(bins - 1), F.floor(clamp(value) * bins)).cast("int")


def place(items: DataFrame, bins: int, row: Column, col: Column) -> DataFrame:
    return items.withColumn("row", grid_bin(row, bins)).withColumn("col", grid_bin(col, bins))


def archive_upsert(
    archive: DataFrame | None, batch: DataFrame, keys: Sequence[str], item: str = "item"
) -> DataFrame:
    """Best item per cell; an incumbent wins ties, then the earlier one (``seq``)."""
    cols = [*keys, *CELL, "fitness", item, "seq"]
    rows = batch.filter(F.col("fitness").isNotNull()).select(*cols)
    if archive is not None:
        old = archive.withColumn("seq", F.lit(-1).cast(dict(batch.dtypes)["seq"]))
        rows = old.select(*cols).unionByName(rows)
    best = F.max_by(F.struct("fitness", item), F.struct("fitness", -F.col("seq")))
    return rows.groupBy(*keys, *CELL).agg(best.alias("_b")).select(
        *keys, *CELL, F.col("_b.fitness").alias("fitness"), F.col(f"_b.{item}").alias(item)
    )


def inserted_flags(
    archive: DataFrame | None, batch: DataFrame, keys: Sequence[str], bucket: Column
) -> DataFrame:
    """Was each batch item better than everything in its cell at its turn?

    ``bucket`` is any function that grows with ``seq``; it splits a hot cell.
    """
    keys = list(keys)
    rows = batch.filter(F.col("fitness").isNotNull())
    out = running_max(rows, [*keys, *CELL], ["seq"], bucket, F.col("fitness"), "_best")
    if archive is not None:
        old = archive.select(*keys, *CELL, F.col("fitness").alias("_old"))
        out = out.join(old, [*keys, *CELL], "left").withColumn("_best", F.greatest("_best", "_old"))
    return out.withColumn(
        "inserted", F.col("_best").isNull() | (F.col("fitness") > F.col("_best"))
    ).drop("_best", "_old")


def archive_stats(archive: DataFrame, archives: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Coverage, cell count, best and mean fitness; empty archives show zeros."""
    stats = archive.groupBy(*keys).agg(
        F.count("*").alias("coverage"),
        F.max("fitness").alias("best_fitness"),
        F.avg("fitness").alias("mean_fitness"),
    )
    return (
        archives.select(*keys).distinct().join(stats, list(keys), "left")
        .fillna({"coverage": 0, "best_fitness": 0.0, "mean_fitness": 0.0})
        .withColumn("total_cells", F.lit(bins * bins))
    )


def archive_heatmap(archive: DataFrame, archives: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Every cell of every grid in long form; empty cells are NaN."""
    keys = list(keys)
    axis = F.sequence(F.lit(0), F.lit(bins - 1))
    grid = (
        archives.select(*keys).distinct()
        .withColumn("row", F.explode(axis)).withColumn("col", F.explode(axis))
    )
    return grid.join(archive.select(*keys, *CELL, "fitness"), [*keys, *CELL], "left").withColumn(
        "fitness", F.coalesce("fitness", F.lit(float("nan")))
    )


def top_cells(archive: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("fitness"), "row", "col")
    return archive.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def top_proposals(cells: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """Best proposals over all seeds, one per claim, empty claims skipped."""
    best = (
        cells.filter(F.length("claim") > 0)
        .groupBy(*keys, "claim")
        .agg(F.max_by(F.struct("fitness", "id"), F.struct("fitness", F.col("id"))).alias("b"))
        .select(*keys, "claim", "b.fitness", "b.id")
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("fitness"), "claim")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def island_redistribute(
    ranked: DataFrame, islands: DataFrame, keys: Sequence[str], n_islands: int, keep: int = 5
) -> DataFrame:
    """Batch item of rank r (0-based) is prepended to island r mod N; each keeps ``keep``.

    ``islands(keys…, island, slot, item)``; the newest batch item ends up first.
    """
    keys = list(keys)
    new = ranked.select(
        *keys,
        (F.col("rank") % n_islands).cast("int").alias("island"),
        (-F.col("rank") - 1).cast("long").alias("_at"),
        "item",
    )
    old = islands.select(*keys, F.col("island").cast("int").alias("island"),
                         F.col("slot").cast("long").alias("_at"), "item")
    order = Window.partitionBy(*keys, "island").orderBy("_at")
    return (
        new.unionByName(old)
        .withColumn("slot", F.row_number().over(order) - 1)
        .filter(F.col("slot") < keep)
        .drop("_at")
    )


def ring_migration(islands: DataFrame, keys: Sequence[str], n_islands: int, keep: int = 5) -> DataFrame:
    """The head of island i−1 is prepended to island i; each keeps ``keep`` items."""
    keys = list(keys)
    heads = islands.filter("slot = 0").select(
        *keys, F.pmod(F.col("island") + 1, F.lit(n_islands)).cast("int").alias("island"),
        F.lit(-1).cast("long").alias("_at"), "item",
    )
    if n_islands < 2:
        return islands.filter(F.col("slot") < keep)
    old = islands.select(*keys, F.col("island").cast("int").alias("island"),
                         F.col("slot").cast("long").alias("_at"), "item")
    order = Window.partitionBy(*keys, "island").orderBy("_at")
    return (
        heads.unionByName(old)
        .withColumn("slot", F.row_number().over(order) - 1)
        .filter(F.col("slot") < keep)
        .drop("_at")
    )


def ring_migration_replace_worst(
    members: DataFrame, islands: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """The best of each island replaces the worst of the next when strictly better.

    ``members(keys…, island, id, score)``, ``islands(keys…, island)`` with dense
    indices from 0.  Bests are read before any replacement; an empty target
    takes the migrant.
    """
    keys = list(keys)
    ends = members.groupBy(*keys, "island").agg(
        F.max_by("id", F.struct(F.col("score"), F.col("id"))).alias("best_id"),
        F.max("score").alias("best_score"),
        F.min_by("id", F.struct(F.col("score"), F.col("id"))).alias("worst_id"),
        F.min("score").alias("worst_score"),
    )
    counts = islands.groupBy(*keys).agg(F.count("*").alias("_n"))
    ring = islands.join(counts, keys).filter("_n > 1")
    source = ends.join(counts, keys).select(
        *keys, F.pmod(F.col("island") + 1, F.col("_n")).alias("island"), "best_id", "best_score"
    )
    moves = (
        ring.join(source, [*keys, "island"])
        .join(ends.select(*keys, "island", "worst_id", "worst_score"), [*keys, "island"], "left")
        .filter(F.col("worst_score").isNull() | (F.col("best_score") > F.col("worst_score")))
    )
    dropped = moves.select(*keys, "island", F.col("worst_id").alias("id"))
    arrived = moves.select(
        *keys, F.col("island").cast("int").alias("island"), F.col("best_id").alias("id"),
        F.col("best_score").alias("score"),
    )
    kept = members.join(dropped, [*keys, "island", "id"], "left_anti")
    return kept.select(*keys, F.col("island").cast("int").alias("island"), "id", "score").unionByName(arrived)


def survivors(members: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """The ``size`` best members per island."""
    order = Window.partitionBy(*keys, "island").orderBy(F.desc("score"), "id")
    return members.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)


def exemplar_sample(
    cells: DataFrame,
    keys: Sequence[str],
    k: int,
    seed: int = 42,
    exclude_island: int | None = None,
) -> DataFrame:
    """A seeded uniform sample of k occupied cells; ids shared by archives count once."""
    rows = cells
    if exclude_island is not None:
        rows = rows.filter(F.coalesce(F.col("island") != exclude_island, F.lit(True)))
    unique = rows.select(*keys, "id").distinct()
    order = Window.partitionBy(*keys).orderBy(text_hash(F.lit(seed), "id"), "id")
    return unique.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def island_best(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best member per island."""
    return members.groupBy(*keys, "island").agg(
        F.max_by("id", F.struct(F.col("score"), F.col("id"))).alias("best_id"),
        F.max("score").alias("best_score"),
    )


def global_best(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return members.groupBy(*keys).agg(F.max("score").alias("global_best"))


def recent_k(events: DataFrame, keys: Sequence[str], k: int, text: str = "text", at: str = "pos") -> DataFrame:
    """The last k distinct texts by their latest position."""
    last = events.groupBy(*keys, text).agg(F.max(at).alias(at))
    order = Window.partitionBy(*keys).orderBy(F.desc(at), text)
    return last.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
