"""Undirected customer–part–supplier graphs: one per order month, or one per block of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.catalog.registry import query, rounded, table
from edgeloom.operators import invariants as I
from edgeloom.session import pin

CORPUS_SQL = """ge AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS graph_id, unnest([
     {'u': 'c' || o_custkey, 'v': 'p' || l_partkey}, {'u': 'p' || l_partkey, 'v': 's' || l_suppkey}, {'u': 'c' || o_custkey, 'v': 's' || l_suppkey}]) AS e
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
gl AS (SELECT graph_id, e.u AS u, e.v AS v FROM ge),
gb AS (SELECT graph_id, u AS x, v AS y FROM gl UNION ALL SELECT graph_id, v, u FROM gl),
gn AS (SELECT DISTINCT graph_id, v FROM (SELECT strftime(o_orderdate, '%Y-%m') AS graph_id, 'c' || o_custkey AS v FROM orders UNION ALL SELECT graph_id, x FROM gb)),
dg AS (SELECT n.graph_id, n.v, coalesce(d, 0) AS deg FROM gn n LEFT JOIN (SELECT graph_id, x AS v, count(*) AS d FROM gb GROUP BY ALL) USING (graph_id, v)),
tn AS (SELECT a.graph_id, a.u AS c, a.v AS p, b.v AS s FROM gl a JOIN gl b ON b.graph_id = a.graph_id AND b.u = a.v JOIN gl k ON k.graph_id = a.graph_id AND k.u = a.u AND k.v = b.v),
tv AS (SELECT graph_id, v, count(*) AS t FROM (SELECT graph_id, unnest([c, p, s]) AS v FROM tn) GROUP BY ALL)"""


#: Orders a block graph is made of. All rows are in some block; more data makes more graphs, not larger
#: ones, which is what invariants of a whole graph (spectra, all-pairs paths) can afford.
BLOCK = 128
BLOCK_SQL = CORPUS_SQL.replace("strftime(o_orderdate, '%Y-%m')", f"o_orderkey // {BLOCK}")


def block_graphs(spark, d):
    return month_graphs(spark, d, f"o_orderkey div {BLOCK}")


def month_ids(spark, d):
    """Every graph of ``month_graphs``: each order gives a node, and every edge is of some order's month."""
    return table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("graph_id")).distinct()


def month_graphs(spark, d, graph="date_format(o_orderdate, 'yyyy-MM')"):
    """``(nodes, edges)``: customers of an order are nodes even without lines."""
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("c"), F.expr(graph).alias("graph_id")
    )
    lines = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "graph_id", "c", F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s")
    )
    ends = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = lines.select("graph_id", F.inline(F.array(ends("c", "p"), ends("p", "s"), ends("c", "s")))).distinct()
    nodes = (
        edges.select("graph_id", F.explode(F.array("u", "v")).alias("v"))
        .unionByName(orders.select("graph_id", F.col("c").alias("v"))).distinct()
    )
    return nodes, edges


def month_lines(spark, d):
    """``(lonely, edges)`` of the same graphs with numbered nodes: kind and key in one long.

    ``edges`` keep their copies, and ``lonely`` has the customers of all orders; one narrow table of lines is written.
    """
    number = lambda column, kind: (F.col(column).cast("long") * 3 + kind)
    orders = table(spark, d, "orders").select(
        "o_orderkey", number("o_custkey", 0).alias("c"), F.date_format("o_orderdate", "yyyy-MM").alias("graph_id")
    )
    lines = pin(
        table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("graph_id", "c", number("l_partkey", 1).alias("p"), number("l_suppkey", 2).alias("s"))
    )
    ends = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = lines.select("graph_id", F.inline(F.array(ends("c", "p"), ends("p", "s"), ends("c", "s"))))
    return orders.select("graph_id", F.col("c").alias("v")), edges


def line_name(number):
    """The name of a node of ``month_lines``."""
    kind = F.get(F.array(*[F.lit(k) for k in "cps"]), F.pmod(F.col(number), F.lit(3)).cast("int"))
    return F.concat(kind, ((F.col(number) - F.pmod(F.col(number), F.lit(3))) / 3).cast("long").cast("string"))


G1 = """SELECT graph_id, count(*) AS n, (sum(deg) / 2)::BIGINT AS m, coalesce(sum(deg) / nullif(count(*) * (count(*) - 1), 0), 0) AS density, avg(deg) AS avg_degree,
   max(deg) AS max_degree, min(deg) AS min_degree, stddev_pop(deg) AS std_degree FROM dg GROUP BY graph_id"""


@query("G1_degree_features", rounded("density, avg_degree, std_degree", f"WITH {CORPUS_SQL} {G1}"))
def degree_features(spark, d):
    nodes, edges = month_graphs(spark, d)
    return I.degree_features(I.degrees(nodes, I.simple_pairs(edges)))


@query("T9_degree_sequence", f"WITH {CORPUS_SQL} SELECT graph_id, deg, count(*) AS n_nodes FROM dg GROUP BY ALL")
def sequence(spark, d):
    nodes, edges = month_graphs(spark, d)
    return I.degree_sequence(I.degrees(nodes, I.simple_pairs(edges)))


@query(
    "G2_triangles_undirected",
    f"WITH {CORPUS_SQL} SELECT g.graph_id, coalesce(n, 0) AS num_triangles FROM (SELECT DISTINCT graph_id FROM gn) g LEFT JOIN (SELECT graph_id, count(*) AS n FROM tn GROUP BY graph_id) USING (graph_id)",
)
def triangles(spark, d):
    lonely, edges = month_lines(spark, d)
    return I.triangles_undirected(lonely, I.node_features(lonely, edges))


CL = """SELECT graph_id, avg(CASE WHEN deg >= 2 THEN coalesce(t, 0) / (deg * (deg - 1) / 2) ELSE 0 END) AS avg_clustering,
   coalesce(sum(coalesce(t, 0)) / nullif(sum(deg * (deg - 1) / 2), 0), 0) AS transitivity FROM dg LEFT JOIN tv USING (graph_id, v) GROUP BY graph_id"""


def _clustering(spark, d):
    return I.graph_clustering(I.node_features(*month_lines(spark, d)))


@query("G3_avg_clustering", rounded("avg_clustering", f"WITH {CORPUS_SQL} SELECT graph_id, avg_clustering FROM ({CL})"))
def avg_clustering(spark, d):
    return _clustering(spark, d).select("graph_id", "avg_clustering")


@query("G4_transitivity", rounded("transitivity", f"WITH {CORPUS_SQL} SELECT graph_id, transitivity FROM ({CL})"))
def transitivity(spark, d):
    return _clustering(spark, d).select("graph_id", "transitivity")


@query(
    "G5_degree_assortativity",
    rounded(
        "degree_assortativity",
        f"""WITH {CORPUS_SQL} SELECT g.graph_id, coalesce(r, 0) AS degree_assortativity FROM (SELECT DISTINCT graph_id FROM gn) g LEFT JOIN (
            SELECT gb.graph_id, CASE WHEN min(a.deg) = max(a.deg) THEN 0 ELSE corr(a.deg, b.deg) END AS r FROM gb JOIN dg a ON a.graph_id = gb.graph_id AND a.v = x
            JOIN dg b ON b.graph_id = gb.graph_id AND b.v = y GROUP BY gb.graph_id) USING (graph_id)""",
    ),
)
def assortativity(spark, d):
    lonely, edges = month_lines(spark, d)
    return I.degree_assortativity(pin(I.node_features(lonely, edges)), I.as_pairs(edges))


COMPONENTS_SQL = """cc(graph_id, id, label) USING KEY (graph_id, id) AS (SELECT graph_id, v, v FROM gn UNION
          SELECT gb.graph_id, gb.y, min(cc.label) FROM cc JOIN gb ON cc.graph_id = gb.graph_id AND cc.id = gb.x
          JOIN recurring.cc AS old ON old.graph_id = gb.graph_id AND old.id = gb.y WHERE cc.label < old.label GROUP BY gb.graph_id, gb.y),
        sz AS (SELECT graph_id, label, count(*) AS n FROM cc GROUP BY ALL),
        best AS (SELECT graph_id, label, n FROM sz QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, label) = 1),
        lc AS (SELECT graph_id, id AS v, n FROM cc JOIN best USING (graph_id, label))"""


def _block_paths(spark, d):
    return I.path_targets(I.distances(*block_graphs(spark, d), largest=True))


@query("G6_avg_shortest_path")
def shortest_paths(spark, d):
    return _block_paths(spark, d).select("graph_id", "average_shortest_path_length")


@query("G7_diameter")
def diameter(spark, d):
    return _block_paths(spark, d).select("graph_id", "diameter")


@query("G8_spectral_radius")
def radius(spark, d):
    return I.spectra(*block_graphs(spark, d), ["spectral_radius"])


@query("G9_algebraic_connectivity")
def connectivity(spark, d):
    return I.spectra(*block_graphs(spark, d), ["algebraic_connectivity"], largest=True)


@query("G10_spectral_pack")
def pack(spark, d):
    return I.spectra(*block_graphs(spark, d), I.SPECTRAL_FEATURES)


@query("G11_invariant_matrix")
def matrix(spark, d):
    return I.invariant_matrix(*block_graphs(spark, d))


@query("G12_target_values")
def targets(spark, d):
    nodes, edges = block_graphs(spark, d)
    return I.target_values(nodes, edges, "diameter")


@query(
    "G13_largest_component",
    f"WITH RECURSIVE {CORPUS_SQL}, {COMPONENTS_SQL} SELECT graph_id, v FROM lc",
)
def largest(spark, d):
    return I.largest_members(*month_lines(spark, d), line_name)
