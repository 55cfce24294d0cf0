"""The data model: two DataFrames per graph set, and the edge-type vocabulary.

``entities(keys…, id, entity_type)`` and ``edges(keys…, src, dst, et)``.  Edges
form a multigraph: equal rows are separate edges and are never de-duplicated
implicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

# The closed edge-type vocabulary, in index order.
EDGE_TYPES = (
    "depends_on",
    "derives",
    "equivalent_to",
    "maps_to",
    "explains",
    "contradicts",
    "generalizes",
)
CONTRADICTS = "contradicts"

# The four kinds of proposed mutation.
PROPOSAL_TYPES = ("add_edge", "remove_edge", "add_entity", "remove_entity")

PROPOSAL_FIELDS = (
    "id",
    "proposal_type",
    "claim",
    "justification",
    "falsification_condition",
    "kg_domain",
    "source_entity",
    "target_entity",
    "edge_type",
    "entity_id",
    "entity_type",
)

PROPOSAL = T.StructType([T.StructField(name, T.StringType()) for name in PROPOSAL_FIELDS])

ENTITY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)
EDGE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("edge_type", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)
KG_DOCUMENT = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("entities", T.ArrayType(ENTITY)),
        T.StructField("edges", T.ArrayType(EDGE)),
    ]
)

ARCHIVE_CELL = T.StructType(
    [
        T.StructField("proposal", PROPOSAL),
        T.StructField("fitness_signal", T.DoubleType()),
    ]
)


def type_bit(et: Column | str) -> Column:
    """An edge type as one bit, so a set of types is a small integer."""
    col = F.col(et) if isinstance(et, str) else et
    bit = F.lit(0)
    for i, name in reversed(list(enumerate(EDGE_TYPES))):
        bit = F.when(col == name, F.lit(1 << i)).otherwise(bit)
    return bit


def mask_names(mask: Column | str) -> Column:
    """A type mask back as a comma-separated list of names in index order."""
    col = F.col(mask) if isinstance(mask, str) else mask
    parts = [
        F.when(col.bitwiseAND(1 << i) != 0, F.lit(name)) for i, name in enumerate(EDGE_TYPES)
    ]
    return F.concat_ws(",", *parts)
