"""Typed graphs, corpora, logs and metric tables derived from the star schema.

Each derivation exists twice: as a DataFrame and as SQL common table
expressions, so that a query and its twin start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.catalog.registry import table
from edgeloom.session import pin
from edgeloom.sources.kg import attributes_to_facts, map_relations

# Relation → edge type; the third column says whether head and tail swap.
RELATIONS = [
    ("nation_region", "maps_to", False),
    ("customer_nation", "depends_on", False),
    ("supplier_nation", "depends_on", False),
    ("order_customer", "derives", False),
    ("order_part", "explains", False),
    ("supplies", "generalizes", True),
    ("returned_from", "contradicts", False),
    ("accepted_from", "explains", False),
    ("pending_from", "equivalent_to", False),
]


def relation_mapping(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{r}', '{et}', {str(inv).lower()})" for r, et, inv in RELATIONS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS m(relation, et, invert)")


#: Kinds of nodes by their code; proposals also name new ones.
KINDS = ("region", "nation", "customer", "supplier", "order", "part", "new")


def node(kind: str, col: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))


def node_number(kind: str, col: str) -> Column:
    """The same node as one integer: eight times its key, and the code of its kind."""
    return F.col(col).cast("long") * 8 + KINDS.index(kind)


def kind_of(number: Column | str) -> Column:
    code = F.pmod(F.col(number) if isinstance(number, str) else number, F.lit(8)).cast("int")
    return F.get(F.array(*[F.lit(k) for k in KINDS]), code)


def node_text(number: str) -> Column:
    """The text of a numbered node."""
    return F.concat_ws(":", kind_of(number), F.shiftright(number, 3).cast("string"))


def number_of(text: str) -> Column:
    """The number of a node given as text; null for null."""
    kind = F.substring_index(text, ":", 1)
    code = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind) - 1
    return F.substring_index(text, ":", -1).cast("long") * 8 + code


def _order_regions(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = table(spark, d, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return customers.select("c_custkey", F.col("r_name").alias("domain"))


def region_facts(spark: SparkSession, d: str, node: Callable[[str, str], Column] = node) -> DataFrame:
    """``(domain, relation, head, tail)`` with the region name as the graph key."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn(
        "domain", F.col("r_name")
    )
    own = _order_regions(spark, d)
    orders = table(spark, d, "orders").join(own, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, d, "lineitem").join(
        orders.select("o_orderkey", "domain"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    nation_of = named.select("n_nationkey", "domain")
    flagged = (
        F.when(F.col("l_returnflag") == "R", "returned_from")
        .when(F.col("l_returnflag") == "A", "accepted_from")
        .otherwise("pending_from")
    )
    line_rows = F.array(
        F.struct(F.lit("order_part").alias("relation"), node("order", "l_orderkey").alias("head"),
                 node("part", "l_partkey").alias("tail")),
        F.struct(F.lit("supplies").alias("relation"), node("supplier", "l_suppkey").alias("head"),
                 node("part", "l_partkey").alias("tail")),
        F.struct(flagged.alias("relation"), node("order", "l_orderkey").alias("head"),
                 node("supplier", "l_suppkey").alias("tail")),
    )
    facts = [
        attributes_to_facts(named, ["domain"], node("nation", "n_nationkey"),
                            {"nation_region": node("region", "n_regionkey")}),
        attributes_to_facts(
            table(spark, d, "customer").join(
                nation_of, F.col("c_nationkey") == F.col("n_nationkey")
            ),
            ["domain"], node("customer", "c_custkey"),
            {"customer_nation": node("nation", "c_nationkey")},
        ),
        attributes_to_facts(
            table(spark, d, "supplier").join(
                nation_of, F.col("s_nationkey") == F.col("n_nationkey")
            ),
            ["domain"], node("supplier", "s_suppkey"),
            {"supplier_nation": node("nation", "s_nationkey")},
        ),
        attributes_to_facts(orders, ["domain"], node("order", "o_orderkey"),
                            {"order_customer": node("customer", "o_custkey")}),
        lines.select("domain", F.inline(line_rows)),
    ]
    out = facts[0]
    for part in facts[1:]:
        out = out.unionByName(part)
    return out


def region_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges ``(domain, src, dst, et)`` of one graph per region."""
    return map_relations(region_facts(spark, d), relation_mapping(spark))


def endpoint_entities(edges: DataFrame) -> DataFrame:
    """Entities ``(domain, id, entity_type)``: every endpoint, typed by its prefix."""
    return (
        edges.select("domain", F.explode(F.array("src", "dst")).alias("id"))
        .distinct()
        .withColumn("entity_type", F.substring_index("id", ":", 1))
    )


def numbered_kg(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """``region_kg`` with numbered nodes, for results that name none: numbers sort, hash and shuffle faster than texts."""
    edges = pin(map_relations(region_facts(spark, d, node_number), relation_mapping(spark)))
    ends = edges.select("domain", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return pin(ends.withColumn("entity_type", kind_of("id"))), edges


def region_kg(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entities and edges; the joined edges are written once, as every user scans them often."""
    edges = pin(region_edges(spark, d))
    return pin(endpoint_entities(edges)), edges


FACTS_SQL = """
nr AS (SELECT n_nationkey, n_regionkey, r_name AS domain
       FROM nation JOIN region ON n_regionkey = r_regionkey),
cd AS (SELECT c_custkey, c_nationkey, domain FROM customer JOIN nr ON c_nationkey = n_nationkey),
od AS (SELECT o_orderkey, o_custkey, domain FROM orders JOIN cd ON o_custkey = c_custkey),
ld AS (SELECT l.*, od.domain FROM lineitem l JOIN od ON l_orderkey = o_orderkey),
facts AS (
  SELECT domain, 'nation_region' AS relation, 'nation:'||n_nationkey AS head, 'region:'||n_regionkey AS tail FROM nr
  UNION ALL SELECT domain, 'customer_nation', 'customer:'||c_custkey, 'nation:'||c_nationkey FROM cd
  UNION ALL SELECT domain, 'supplier_nation', 'supplier:'||s_suppkey, 'nation:'||s_nationkey
            FROM supplier JOIN nr ON s_nationkey = n_nationkey
  UNION ALL SELECT domain, 'order_customer', 'order:'||o_orderkey, 'customer:'||o_custkey FROM od
  UNION ALL SELECT domain, 'order_part', 'order:'||l_orderkey, 'part:'||l_partkey FROM ld
  UNION ALL SELECT domain, 'supplies', 'supplier:'||l_suppkey, 'part:'||l_partkey FROM ld
  UNION ALL SELECT domain, CASE l_returnflag WHEN 'R' THEN 'returned_from' WHEN 'A' THEN 'accepted_from'
            ELSE 'pending_from' END, 'order:'||l_orderkey, 'supplier:'||l_suppkey FROM ld)
"""

KG_SQL = (
    FACTS_SQL
    + """,
relation_map(relation, et, invert) AS (VALUES
  ('nation_region','maps_to',false), ('customer_nation','depends_on',false),
  ('supplier_nation','depends_on',false), ('order_customer','derives',false),
  ('order_part','explains',false), ('supplies','generalizes',true),
  ('returned_from','contradicts',false), ('accepted_from','explains',false),
  ('pending_from','equivalent_to',false)),
edges AS (
  SELECT domain, CASE WHEN invert THEN tail ELSE head END AS src,
         CASE WHEN invert THEN head ELSE tail END AS dst, et
  FROM facts JOIN relation_map USING (relation)),
entities AS (
  SELECT DISTINCT domain, id, split_part(id, ':', 1) AS entity_type
  FROM (SELECT domain, src AS id FROM edges UNION ALL SELECT domain, dst FROM edges))
"""
)


def with_kg(body: str, more: str = "") -> str:
    """``body`` behind the graph CTEs (and further CTEs in ``more``)."""
    tail = f", {more}" if more else ""
    return f"WITH RECURSIVE {KG_SQL}{tail} {body}"
