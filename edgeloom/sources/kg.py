"""Typed graphs: JSON documents in and out, integrity checks, relational input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.keys import expand_copies
from edgeloom.schema import EDGE_TYPES, KG_DOCUMENT


def read_kg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON document per graph → ``(entities, edges)`` keyed by domain."""
    docs = spark.read.schema(KG_DOCUMENT).json(path, multiLine=True)
    return document_entities(docs), document_edges(docs)


def document_entities(docs: DataFrame) -> DataFrame:
    return docs.select("domain", F.explode("entities").alias("e")).select(
        "domain", "e.id", "e.entity_type", "e.properties"
    )


def document_edges(docs: DataFrame) -> DataFrame:
    return docs.select("domain", F.explode("edges").alias("e")).select(
        "domain",
        F.col("e.source").alias("src"),
        F.col("e.target").alias("dst"),
        normalise_edge_type(F.col("e.edge_type")).alias("et"),
        "e.properties",
    )


def normalise_edge_type(col: Column) -> Column:
    """Upper-case names and lower-case values mean the same type."""
    return F.lower(col)


# A document is one row, so its size must be bounded; a larger graph is written
# as several documents of the same domain, which the reader merges by itself.
ROWS_PER_DOCUMENT = 50_000


def write_kg_documents(
    entities: DataFrame, edges: DataFrame, path: str, rows: int = ROWS_PER_DOCUMENT
) -> None:
    kg_documents(entities, edges, rows).write.mode("overwrite").json(path)


def kg_documents(
    entities: DataFrame, edges: DataFrame, rows: int = ROWS_PER_DOCUMENT
) -> DataFrame:
    """``(domain, part, entities, edges)`` documents of about ``rows`` items each."""
    empty = F.create_map().cast("map<string,string>")

    def props(df: DataFrame) -> Column:
        return (F.col("properties") if "properties" in df.columns else empty).alias("properties")

    sizes = (
        entities.select("domain").unionByName(edges.select("domain"))
        .groupBy("domain").agg(F.ceil(F.count("*") / rows).alias("_parts"))
    )

    def packed(df: DataFrame, identity: Sequence[str], item: Column, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*identity), F.col("_parts")).alias("part")
        return (
            df.join(sizes, "domain").select("domain", part, item.alias("_item"))
            .groupBy("domain", "part").agg(F.collect_list("_item").alias(name))
        )

    nodes = packed(entities, ["id"], F.struct("id", "entity_type", props(entities)), "entities")
    # Copies of one edge are numbered, so that they spread over the parts too.
    same = ["domain", "src", "dst", "et", "_props"]
    counted = (
        edges.select("domain", "src", "dst", "et", F.to_json(props(edges)).alias("_props"))
        .groupBy(*same).agg(F.count("*").alias("_n"))
    )
    copies = expand_copies(counted, "_n", "_copy")
    link = F.struct(
        F.col("src").alias("source"), F.col("dst").alias("target"), F.col("et").alias("edge_type"),
        F.from_json("_props", "map<string,string>").alias("properties"),
    )
    links = packed(copies, [*same[1:], "_copy"], link, "edges")
    return nodes.join(links, ["domain", "part"], "full_outer")


def write_kg_tables(entities: DataFrame, edges: DataFrame, path: str) -> None:
    """The form for large graphs: Parquet, partitioned by domain."""
    entities.write.mode("overwrite").partitionBy("domain").parquet(f"{path}/entities")
    edges.write.mode("overwrite").partitionBy("domain").parquet(f"{path}/edges")


def read_kg_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/edges")


def integrity_violations(
    entities: DataFrame, edges: DataFrame, keys: Sequence[str] = ("domain",)
) -> DataFrame:
    """Rows ``(keys…, kind, id, n)``: duplicate ids, dangling endpoints, unknown types."""
    keys = list(keys)
    duplicates = (
        entities.groupBy(*keys, "id")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select(*keys, F.lit("duplicate_id").alias("kind"), "id", "n")
    )
    known = entities.select(*keys, "id").distinct()
    # Count per endpoint first: a hub shuffles one row per task, not its edges.
    ends = (
        edges.select(
            *keys,
            F.inline(
                F.array(
                    F.struct(F.lit("dangling_source").alias("kind"), F.col("src").alias("id")),
                    F.struct(F.lit("dangling_target").alias("kind"), F.col("dst").alias("id")),
                )
            ),
        )
        .groupBy(*keys, "kind", "id")
        .agg(F.count("*").alias("n"))
    )
    dangling = ends.join(known, [*keys, "id"], "left_anti").select(*keys, "kind", "id", "n")
    unknown = (
        edges.filter(F.col("et").isNull() | ~F.col("et").isin(*EDGE_TYPES))
        .groupBy(*keys, F.col("et").alias("id"))
        .agg(F.count("*").alias("n"))
        .select(*keys, F.lit("unknown_edge_type").alias("kind"), "id", "n")
    )
    return duplicates.unionByName(dangling).unionByName(unknown)


def require_integrity(
    entities: DataFrame, edges: DataFrame, keys: Sequence[str] = ("domain",)
) -> None:
    """Raise with one example when any integrity rule is broken."""
    bad = integrity_violations(entities, edges, keys).first()
    if bad is not None:
        raise ValueError(f"graph integrity violated: {bad.asDict()}")


def map_relations(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Foreign relations onto the edge-type vocabulary.

    ``facts(…, relation, head, tail)`` ⋈ ``mapping(relation, et, invert)``;
    an inverted relation swaps its ends, an unmapped one is dropped.  The mapping
    is broadcast when its measured size is below the session's threshold.
    """
    rest = [c for c in facts.columns if c not in ("relation", "head", "tail")]
    return facts.join(mapping, "relation").select(
        *rest,
        F.when(F.col("invert"), F.col("tail")).otherwise(F.col("head")).alias("src"),
        F.when(F.col("invert"), F.col("head")).otherwise(F.col("tail")).alias("dst"),
        "et",
    )


def attributes_to_facts(
    df: DataFrame, keys: Sequence[str], head: Column, attributes: dict[str, Column]
) -> DataFrame:
    """Attribute columns of one table as ``(keys…, relation, head, tail)`` in one scan."""
    rows = [
        F.struct(F.lit(name).alias("relation"), head.alias("head"), tail.alias("tail"))
        for name, tail in attributes.items()
    ]
    return (
        df.select(*keys, F.inline(F.array(*rows)))
        .filter(F.col("head").isNotNull() & F.col("tail").isNotNull())
    )
