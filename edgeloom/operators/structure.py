"""Structural quality of typed graphs: compressibility, coherence, symmetry.

Each function returns one row per ``keys``.  A graph without edges scores 1.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.numeric import clamp, entropy_bits
from edgeloom.operators.components import component_stars, forest_sizes
from edgeloom.operators.triangles import directed_triangle_counts, triangle_counts_before_after
from edgeloom.schema import CONTRADICTS, EDGE_TYPES
from edgeloom.session import pin

N_TYPES = len(EDGE_TYPES)


def _count_name(i: int) -> str:
    return f"t{i}"


TYPE_COUNTS = [_count_name(i) for i in range(N_TYPES)]


def type_counts(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per graph: edge count and one count per edge type."""
    counts = [F.count_if(F.col("et") == et).alias(_count_name(i)) for i, et in enumerate(EDGE_TYPES)]
    return edges.groupBy(*keys).agg(F.count("*").alias("n_edges"), *counts)


def entropy_score(counts: Sequence[Column], n_types: int = N_TYPES) -> Column:
    return F.lit(1.0) - entropy_bits(list(counts)) / math.log2(n_types)


def edge_type_entropy_score(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """1 − H/log2(number of types); parallel edges count."""
    return type_counts(edges, keys).select(
        *keys, entropy_score([F.col(c) for c in TYPE_COUNTS]).alias("entropy_score")
    )


def spanning_fraction(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spanning-forest edges over all edges, on the undirected view."""
    forest = forest_sizes(edges, keys)
    return (
        edges.groupBy(*keys)
        .agg(F.count("*").alias("n_edges"))
        .join(forest, list(keys), "left")
        .select(
            *keys,
            (F.coalesce("n_forest", F.lit(0)) / F.col("n_edges")).alias("spanning_fraction"),
        )
    )


def compressibility(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        edge_type_entropy_score(edges, keys)
        .join(spanning_fraction(edges, keys), list(keys))
        .select(
            *keys,
            ((F.col("entropy_score") + F.col("spanning_fraction")) / 2).alias("compressibility"),
        )
    )


def triangle_coherence(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of ordered triples whose closing pair shares a type with its legs."""
    graphs = edges.select(*keys).distinct()
    share = F.col("n_coherent") / F.nullif(F.col("n_triangles"), F.lit(0))
    return graphs.join(directed_triangle_counts(edges, keys), list(keys), "left").select(
        *keys,
        F.coalesce("n_triangles", F.lit(0)).alias("n_triangles"),
        F.coalesce(share, F.lit(1.0)).alias("triangle_coherence"),
    )


def contradiction_free_rate(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edges.groupBy(*keys).agg(
        (1.0 - F.avg((F.col("et") == CONTRADICTS).cast("double"))).alias("contradiction_free_rate")
    )


def coherence(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        triangle_coherence(edges, keys)
        .join(contradiction_free_rate(edges, keys), list(keys))
        .select(
            *keys,
            ((F.col("triangle_coherence") + F.col("contradiction_free_rate")) / 2).alias(
                "coherence"
            ),
        )
    )


def edge_source_type(edges: DataFrame, entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges with the entity type of their source."""
    types = entities.select(
        *keys, F.col("id").alias("src"), F.col("entity_type").alias("source_type")
    )
    return edges.join(types, [*keys, "src"])


def source_profiles(edges: DataFrame, entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per source entity: its type and its out-edge count per edge type.

    Counting first means the join with the entity table sees one row per source.
    """
    keys = list(keys)
    counts = [F.count_if(F.col("et") == et).alias(_count_name(i)) for i, et in enumerate(EDGE_TYPES)]
    per_source = edges.groupBy(*keys, "src").agg(*counts)
    types = entities.select(*keys, F.col("id").alias("src"), "entity_type")
    return per_source.join(types, [*keys, "src"])


def entity_type_profile(edges: DataFrame, entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form: share of each used edge type among a source's out-edges."""
    wide = source_profiles(edges, entities, keys)
    total = sum([F.col(c) for c in TYPE_COUNTS[1:]], F.col(TYPE_COUNTS[0]))
    rows = F.array(
        *[
            F.struct(F.lit(et).alias("et"), F.col(_count_name(i)).alias("n"))
            for i, et in enumerate(EDGE_TYPES)
        ]
    )
    return (
        wide.withColumn("_total", total)
        .select(*keys, "src", "entity_type", "_total", F.inline(rows))
        .filter("n > 0")
        .select(*keys, "src", "entity_type", "et", (F.col("n") / F.col("_total")).alias("share"))
    )


def profile_histogram(profiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct share vectors ``p`` per entity type with their multiplicity ``n``.

    Equal counts collapse before the shuffle, so a type that holds most of the
    graph arrives as its few distinct profiles.
    """
    total = sum([F.col(c) for c in TYPE_COUNTS[1:]], F.col(TYPE_COUNTS[0]))
    shares = F.array(*[F.col(c) / total for c in TYPE_COUNTS])
    return (
        profiles.select(*keys, "entity_type", shares.alias("p"))
        .groupBy(*keys, "entity_type", "p")
        .agg(F.count("*").alias("n"))
    )


def centroids(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unweighted mean profile per entity type, as array ``q``, and its size."""
    weighted = [F.sum(F.col("p")[i] * F.col("n")) / F.sum("n") for i in range(N_TYPES)]
    return histogram.groupBy(*keys, "entity_type").agg(
        F.sum("n").alias("n_sources"), F.array(*weighted).alias("q")
    )


def type_centroid(edges: DataFrame, entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form of the centroids: ``(keys…, entity_type, et, share, n_sources)``."""
    hist = profile_histogram(source_profiles(edges, entities, keys), keys)
    rows = F.array(
        *[
            F.struct(F.lit(et).alias("et"), F.col("q")[i].alias("share"))
            for i, et in enumerate(EDGE_TYPES)
        ]
    )
    return (
        centroids(hist, keys)
        .select(*keys, "entity_type", "n_sources", F.inline(rows))
        .filter("share > 0")
    )


def js_distance(p: Column, q: Column, n: int = N_TYPES) -> Column:
    """Base-2 Jensen–Shannon distance of two share arrays, clamped to [0, 1]."""
    total = F.lit(0.0)
    for i in range(n):
        a, b = p[i], q[i]
        m = (a + b) / 2
        total = (
            total
            + F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
            + F.when(b > 0, b * F.log2(b / m)).otherwise(0.0)
        )
    return clamp(F.sqrt(F.greatest(total / 2, F.lit(0.0))))


def entity_js_distance(edges: DataFrame, entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distance of every source entity's profile from its type's centroid."""
    keys = list(keys)
    profiles = source_profiles(edges, entities, keys)
    total = sum([F.col(c) for c in TYPE_COUNTS[1:]], F.col(TYPE_COUNTS[0]))
    shares = F.array(*[F.col(c) / total for c in TYPE_COUNTS])
    centre = centroids(profile_histogram(profiles, keys), keys)
    return (
        profiles.select(*keys, "src", "entity_type", shares.alias("p"))
        .join(centre, [*keys, "entity_type"])
        .select(
            *keys,
            "src",
            "entity_type",
            F.when(F.col("n_sources") > 1, js_distance(F.col("p"), F.col("q")))
            .otherwise(F.lit(0.0))
            .alias("js"),
        )
    )


def symmetry_by_type(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys…, entity_type, n_sources, js_sum)`` from a profile histogram."""
    keys = list(keys)
    centre = centroids(histogram, keys)
    js = F.when(F.col("n_sources") > 1, js_distance(F.col("p"), F.col("q"))).otherwise(F.lit(0.0))
    return (
        histogram.join(centre, [*keys, "entity_type"])
        .groupBy(*keys, "entity_type")
        .agg(F.first("n_sources").alias("n_sources"), F.sum(js * F.col("n")).alias("js_sum"))
    )


def symmetry(edges: DataFrame, entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size-weighted mean over entity types of 1 − mean JS distance."""
    return symmetry_of(profile_histogram(source_profiles(edges, entities, keys), keys), keys)


def symmetry_of(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    return symmetry_by_type(histogram, keys).groupBy(*keys).agg(
        (1.0 - F.sum("js_sum") / F.sum("n_sources")).alias("symmetry")
    )


def components_table(edges: DataFrame, entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compressibility, coherence and symmetry of every graph, edgeless ones included."""
    keys = list(keys)
    return _components_of(
        entities.groupBy(*keys).agg(F.count("*").alias("n_entities")),
        type_counts(edges, keys),
        forest_sizes(edges, keys),
        directed_triangle_counts(edges, keys),
        symmetry(edges, entities, keys),
        keys,
    )


def components_before_after(
    edges: DataFrame, added: DataFrame, entities: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """``components_table`` of a graph and of it with ``added`` edges.

    Triangles of both are found once; the forest grows by what the added edges
    join, counts and profiles by theirs.
    """
    keys = list(keys)
    graphs = entities.groupBy(*keys).agg(F.count("*").alias("n_entities"))
    added = pin(added.select(*keys, "src", "dst", "et"))

    def summed(rows: DataFrame, by: list[str], columns: Sequence[str]) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])

    counts = pin(type_counts(edges, keys))
    counts_after = summed(counts.unionByName(type_counts(added, keys)), keys, ["n_edges", *TYPE_COUNTS])
    stars = component_stars(edges, keys)
    forest = pin(stars.groupBy(*keys).agg(F.count("*").alias("n_forest")))
    joins = added.select(*keys, "src", "dst")
    for end in ("src", "dst"):
        roots = stars.select(*keys, F.col("u").alias(end), F.col("v").alias("_root"))
        joins = joins.join(roots, [*keys, end], "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    forest_after = summed(forest.unionByName(forest_sizes(pin(joins), keys)), keys, ["n_forest"])
    triangles, triangles_after = triangle_counts_before_after(edges, added, keys)
    profiles = pin(source_profiles(edges, entities, keys))
    more = source_profiles(added, entities, keys)
    profiles_after = summed(profiles.unionByName(more), [*keys, "src", "entity_type"], TYPE_COUNTS)

    def sym(rows: DataFrame) -> DataFrame:
        return symmetry_of(profile_histogram(rows, keys), keys)

    return (
        _components_of(graphs, counts, forest, triangles, sym(profiles), keys),
        _components_of(graphs, counts_after, forest_after, triangles_after, sym(profiles_after), keys),
    )


def _components_of(
    graphs: DataFrame, counts: DataFrame, forest: DataFrame, triangles: DataFrame, sym: DataFrame, keys: list[str]
) -> DataFrame:
    joined = (
        graphs.join(counts, keys, "full_outer")
        .join(forest, keys, "left")
        .join(triangles, keys, "left")
        .join(sym, keys, "left")
    )
    return structural_parts(joined, keys, F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


def structural_parts(counts: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """The three parts from counts of edges, types, forest edges and triangles, and ``symmetry``; nulls are none."""
    n = F.nullif(F.col("n_edges"), F.lit(0))
    spanning = F.coalesce(F.coalesce("n_forest", F.lit(0)) / n, F.lit(1.0))
    entropy = F.coalesce(entropy_score([F.col(c) for c in TYPE_COUNTS]), F.lit(1.0))
    closed = F.coalesce(
        F.col("n_coherent") / F.nullif(F.col("n_triangles"), F.lit(0)), F.lit(1.0)
    )
    free = F.coalesce(1.0 - F.col(_count_name(EDGE_TYPES.index(CONTRADICTS))) / n, F.lit(1.0))
    return counts.select(
        *keys,
        *more,
        F.coalesce("n_edges", F.lit(0)).alias("n_edges"),
        ((entropy + spanning) / 2).alias("compressibility"),
        ((closed + free) / 2).alias("coherence"),
        F.coalesce("symmetry", F.lit(1.0)).alias("symmetry"),
    )


def frequency_dominance(edges: DataFrame, entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How far one edge type dominates, and how sparse the graph is."""
    keys = list(keys)
    sizes = entities.groupBy(*keys).agg(F.count("*").alias("n_entities"))
    cols = [F.col(c) for c in TYPE_COUNTS]
    joined = sizes.join(type_counts(edges, keys), keys, "left")
    has = F.col("n_edges") > 0
    n = F.col("n_entities")
    used_min = F.least(*[F.when(c > 0, c) for c in cols])
    p_max = F.greatest(*cols) / F.col("n_edges")
    room = F.nullif(n * (n - 1), F.lit(0))
    return joined.select(
        *keys,
        F.when(has, entropy_bits(cols)).otherwise(0.0).alias("entropy"),
        F.when(has, clamp(F.coalesce(1.0 - F.col("n_edges") / room, F.lit(0.0))))
        .otherwise(1.0)
        .alias("sparsity"),
        F.when(has, F.greatest(*cols) / used_min).otherwise(0.0).alias("skew"),
        F.when(has, p_max).otherwise(0.0).alias("p_max"),
        F.when(has, p_max - 1.0 / N_TYPES).otherwise(0.0).alias("advantage"),
    )


def kg_inventory(
    edges: DataFrame, entities: DataFrame, keys: Sequence[str], source: Column | None = None
) -> DataFrame:
    """Entity, edge and type counts per graph, with a note of where it came from."""
    keys = list(keys)
    ent = entities.groupBy(*keys).agg(
        F.count("*").alias("n_entities"), F.count_distinct("entity_type").alias("n_entity_types")
    )
    lnk = edges.groupBy(*keys).agg(
        F.count("*").alias("n_edges"), F.count_distinct("et").alias("n_edge_types")
    )
    out = ent.join(lnk, keys, "full_outer").fillna(0)
    return out.withColumn("source", source) if source is not None else out
