"""Typed-graph structure: sources, joins and quality components."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.catalog.derive import region_edges, region_facts, region_kg, relation_mapping, with_kg
from edgeloom.catalog.registry import query, rounded
from edgeloom.operators import structure as S
from edgeloom.operators.components import connected_components
from edgeloom.operators.triangles import directed_triangles
from edgeloom.session import pin
from edgeloom.sources.kg import integrity_violations, map_relations

KEYS = ["domain"]

# ---------------------------------------------------------------- SQL fragments

COUNTS = """counts AS (SELECT domain, et, count(*) AS c FROM edges GROUP BY ALL),
ent AS (SELECT domain, 1 + sum(c / t * log2(c / t)) / log2(7) AS entropy_score
        FROM (SELECT *, sum(c) OVER (PARTITION BY domain) AS t FROM counts) GROUP BY domain)"""

LINKS = """und AS (SELECT DISTINCT domain, src AS x, dst AS y FROM edges WHERE src <> dst
        UNION SELECT DISTINCT domain, dst, src FROM edges WHERE src <> dst),
cc(domain, id, label) USING KEY (domain, id) AS (
    SELECT domain, id, id FROM entities
    UNION
    SELECT und.domain, und.y, min(cc.label)
    FROM cc JOIN und ON cc.domain = und.domain AND cc.id = und.x
    JOIN recurring.cc AS old ON old.domain = und.domain AND old.id = und.y
    WHERE cc.label < old.label GROUP BY und.domain, und.y)"""

SPAN = """span AS (SELECT e.domain, (v.n - v.k) / e.n AS spanning_fraction
    FROM (SELECT domain, count(*) AS n FROM edges GROUP BY domain) e
    JOIN (SELECT domain, count(*) AS n, count(DISTINCT label) AS k FROM cc GROUP BY domain) v USING (domain))"""

PAIRS = """tb AS (SELECT unnest(['depends_on','derives','equivalent_to','maps_to','explains','contradicts','generalizes']) AS et,
             unnest([1,2,4,8,16,32,64]) AS b),
pairs AS (SELECT domain, src, dst, bit_or(b)::INTEGER AS m FROM edges JOIN tb USING (et) GROUP BY domain, src, dst),
triples AS (SELECT ab.domain, ab.src AS a, ab.dst AS b, bc.dst AS c, ab.m AS mab, bc.m AS mbc, ac.m AS mac
  FROM pairs ab JOIN pairs bc ON ab.domain = bc.domain AND ab.dst = bc.src AND bc.dst <> ab.src
  JOIN pairs ac ON ac.domain = ab.domain AND ac.src = ab.src AND ac.dst = bc.dst)"""

COH = """tri AS (SELECT domain, count(*) AS n_triangles,
        avg(CASE WHEN mac & (mab | mbc) <> 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS share FROM triples GROUP BY domain),
free AS (SELECT domain, 1 - avg(CASE WHEN et = 'contradicts' THEN 1.0::DOUBLE ELSE 0.0 END) AS contradiction_free_rate
         FROM edges GROUP BY domain),
coh AS (SELECT domain, coalesce(n_triangles, 0) AS n_triangles, coalesce(share, 1.0) AS triangle_coherence,
        contradiction_free_rate, (coalesce(share, 1.0) + contradiction_free_rate) / 2 AS coherence
        FROM free LEFT JOIN tri USING (domain))"""

SYM = """prof AS (SELECT domain, src, et, count(*) AS c FROM edges GROUP BY ALL),
shares AS (SELECT p.domain, p.src, e.entity_type, p.et, c / sum(c) OVER (PARTITION BY p.domain, p.src) AS share
           FROM prof p JOIN entities e ON e.domain = p.domain AND e.id = p.src),
tsize AS (SELECT domain, entity_type, count(DISTINCT src) AS n_sources FROM shares GROUP BY ALL),
cent AS (SELECT domain, entity_type, et, sum(share) / any_value(n_sources) AS share, any_value(n_sources) AS n_sources
         FROM shares JOIN tsize USING (domain, entity_type) GROUP BY ALL),
grid AS (SELECT s.domain, s.src, s.entity_type, c.et, c.share AS q, c.n_sources
         FROM (SELECT DISTINCT domain, src, entity_type FROM shares) s JOIN cent c USING (domain, entity_type)),
dist AS (SELECT g.domain, g.src, g.entity_type,
   CASE WHEN any_value(n_sources) = 1 THEN 0.0 ELSE least(1.0, sqrt(greatest(0.0, sum(
     CASE WHEN p.share > 0 THEN p.share * log2(p.share / ((p.share + q) / 2)) ELSE 0 END
     + q * log2(q / ((coalesce(p.share, 0) + q) / 2))) / 2))) END AS js
   FROM grid g LEFT JOIN shares p ON p.domain = g.domain AND p.src = g.src AND p.et = g.et
   GROUP BY g.domain, g.src, g.entity_type),
sym AS (SELECT domain, 1 - sum(js) / count(*) AS symmetry FROM dist GROUP BY domain)"""

COMPONENTS = ", ".join([COUNTS, LINKS, SPAN, PAIRS, COH, SYM]) + """,
comp AS (SELECT domain, (SELECT count(*) FROM entities n WHERE n.domain = ent.domain) AS n_entities,
   (SELECT count(*) FROM edges g WHERE g.domain = ent.domain) AS n_edges,
   (entropy_score + spanning_fraction) / 2 AS compressibility, coherence, symmetry
   FROM ent JOIN span USING (domain) JOIN coh USING (domain) JOIN sym USING (domain))"""


# ---------------------------------------------------------------------- sources


@query(
    "S3_kg_integrity",
    with_kg(
        """SELECT domain, kind, id, n FROM (
      SELECT domain, 'dangling_source' AS kind, src AS id, count(*) AS n FROM edges e
        WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.domain = e.domain AND k.id = e.src) GROUP BY ALL
      UNION ALL SELECT domain, 'dangling_target', dst, count(*) FROM edges e
        WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.domain = e.domain AND k.id = e.dst) GROUP BY ALL
      UNION ALL SELECT domain, 'duplicate_id', id, count(*) FROM kept GROUP BY ALL HAVING count(*) > 1)""",
        """kept AS (SELECT domain, id FROM entities WHERE entity_type <> 'nation'
           UNION ALL SELECT domain, id FROM entities WHERE entity_type = 'supplier')""",
    ),
)
def kg_integrity(spark, d):
    """Integrity of a damaged copy: nations missing, suppliers listed twice."""
    entities, edges = region_kg(spark, d)
    kept = entities.filter("entity_type <> 'nation'").unionByName(
        entities.filter("entity_type = 'supplier'")
    )
    return integrity_violations(kept, edges, KEYS)


@query(
    "S4_kg_from_tables",
    with_kg("SELECT domain, src, dst, et, count(*) AS n FROM edges GROUP BY ALL"),
)
def kg_from_tables(spark, d):
    edges = map_relations(region_facts(spark, d), relation_mapping(spark))
    return edges.groupBy("domain", "src", "dst", "et").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------ joins


@query(
    "J1_triangles_directed",
    with_kg("SELECT domain, a, b, c, mac & (mab | mbc) <> 0 AS coherent FROM triples", PAIRS),
)
def triangles_directed(spark, d):
    found = directed_triangles(region_edges(spark, d), KEYS)
    return found.select("domain", "a", "b", "c", "coherent")


@query(
    "J2_edge_source_type",
    with_kg(
        """SELECT e.domain, n.entity_type AS source_type, e.et, e.dst, count(*) AS n
           FROM edges e JOIN entities n ON n.domain = e.domain AND n.id = e.src GROUP BY ALL"""
    ),
)
def edge_source_type(spark, d):
    entities, edges = region_kg(spark, d)
    typed = S.edge_source_type(edges, entities, KEYS)
    return typed.groupBy("domain", "source_type", "et", "dst").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------- components


@query(
    "A1_edge_type_entropy_score",
    rounded("entropy_score", with_kg("SELECT * FROM ent", COUNTS)),
)
def entropy(spark, d):
    return S.edge_type_entropy_score(region_edges(spark, d), KEYS)


@query(
    "A2_spanning_fraction",
    rounded("spanning_fraction", with_kg("SELECT * FROM span", f"{LINKS}, {SPAN}")),
)
def spanning(spark, d):
    return S.spanning_fraction(pin(region_edges(spark, d)), KEYS)


@query(
    "A3_connected_components",
    with_kg("SELECT domain, id, label AS component FROM cc", LINKS),
)
def components(spark, d):
    entities, edges = region_kg(spark, d)
    return connected_components(entities, edges, KEYS)


@query(
    "A4_compressibility",
    rounded(
        "compressibility",
        with_kg(
            """SELECT domain, (entropy_score + spanning_fraction) / 2 AS compressibility
               FROM ent JOIN span USING (domain)""",
            f"{COUNTS}, {LINKS}, {SPAN}",
        ),
    ),
)
def compressibility(spark, d):
    return S.compressibility(pin(region_edges(spark, d)), KEYS)


@query(
    "A5_triangle_coherence",
    rounded(
        "triangle_coherence",
        with_kg("SELECT domain, n_triangles, triangle_coherence FROM coh", f"{PAIRS}, {COH}"),
    ),
)
def triangle_coherence(spark, d):
    return S.triangle_coherence(pin(region_edges(spark, d)), KEYS)


@query(
    "A6_contradiction_free_rate",
    rounded(
        "contradiction_free_rate",
        with_kg(
            """SELECT domain, 1 - avg(CASE WHEN et = 'contradicts' THEN 1.0::DOUBLE ELSE 0.0 END)
               AS contradiction_free_rate FROM edges GROUP BY domain"""
        ),
    ),
)
def contradiction_free(spark, d):
    return S.contradiction_free_rate(region_edges(spark, d), KEYS)


@query(
    "A7_coherence",
    rounded("coherence", with_kg("SELECT domain, coherence FROM coh", f"{PAIRS}, {COH}")),
)
def coherence(spark, d):
    return S.coherence(pin(region_edges(spark, d)), KEYS)


@query(
    "A8_entity_type_profile",
    rounded("share", with_kg("SELECT domain, src, entity_type, et, share FROM shares", SYM)),
)
def profile(spark, d):
    entities, edges = region_kg(spark, d)
    return S.entity_type_profile(edges, entities, KEYS)


@query(
    "A9_type_centroid",
    rounded(
        "share", with_kg("SELECT domain, entity_type, n_sources, et, share FROM cent", SYM)
    ),
)
def centroid(spark, d):
    entities, edges = region_kg(spark, d)
    return S.type_centroid(edges, entities, KEYS)


@query(
    "A10_js_distance",
    rounded("js", with_kg("SELECT domain, src, entity_type, js FROM dist", SYM)),
)
def js(spark, d):
    entities, edges = region_kg(spark, d)
    return S.entity_js_distance(edges, entities, KEYS)


@query("A11_symmetry", rounded("symmetry", with_kg("SELECT * FROM sym", SYM)))
def symmetry(spark, d):
    entities, edges = region_kg(spark, d)
    return S.symmetry(edges, entities, KEYS)


@query(
    "A17_frequency_dominance",
    rounded(
        "entropy, sparsity, skew, p_max, advantage",
        with_kg(
            """SELECT domain, -sum(c / t * log2(c / t)) AS entropy,
                 greatest(0, least(1, 1 - any_value(t) / (any_value(n) * (any_value(n) - 1)))) AS sparsity,
                 max(c) / min(c) AS skew, max(c / t) AS p_max, max(c / t) - 1 / 7 AS advantage
               FROM (SELECT *, sum(c) OVER (PARTITION BY domain) AS t FROM counts)
               JOIN (SELECT domain, count(*) AS n FROM entities GROUP BY domain) USING (domain)
               GROUP BY domain""",
            COUNTS,
        ),
    ),
)
def dominance(spark, d):
    entities, edges = region_kg(spark, d)
    return S.frequency_dominance(edges, entities, KEYS)


@query(
    "A18_kg_inventory",
    with_kg(
        """SELECT domain, n_entities, n_entity_types, n_edges, n_edge_types, 'star schema' AS source
           FROM (SELECT domain, count(*) AS n_entities, count(DISTINCT entity_type) AS n_entity_types
                 FROM entities GROUP BY domain)
           JOIN (SELECT domain, count(*) AS n_edges, count(DISTINCT et) AS n_edge_types
                 FROM edges GROUP BY domain) USING (domain)"""
    ),
)
def inventory(spark, d):
    entities, edges = region_kg(spark, d)
    return S.kg_inventory(edges, entities, KEYS, F.lit("star schema"))
