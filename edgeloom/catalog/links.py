"""Splits, ranking baselines, backtests and embedding scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from edgeloom.catalog.derive import region_kg, with_kg
from edgeloom.catalog.registry import query, rounded, table
from edgeloom.operators import embeddings as E
from edgeloom.operators import ranking as R
from edgeloom.operators import training as TR
from edgeloom.operators.splits import kg_split, mask_split, train_graph
from edgeloom.session import pin

KEYS = ["domain"]

ORDERED = """copies AS (SELECT domain, src, dst, et, row_number() OVER (PARTITION BY domain, src, dst, et) AS copy FROM edges),
hashed AS (SELECT *, md5(concat_ws('|', '42', domain, src, dst, et, copy)) AS h FROM copies),
placed AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY h) AS pos, count(*) OVER (PARTITION BY domain) AS n FROM hashed)"""

MASKED = ORDERED + """,
split AS (SELECT domain, src, dst, et, copy, CASE WHEN pos <= greatest(1, floor(n * 0.2)) THEN 'test' ELSE 'train' END AS split FROM placed)"""

FOUR = ORDERED + """,
sized AS (SELECT *, greatest(1, round_even(n * 0.1, 0)) AS nh FROM placed),
tenths AS (SELECT *, n - nh AS rest, round_even((n - nh) * 0.1, 0) AS tenth FROM sized),
split AS (SELECT domain, src, dst, et, copy, CASE WHEN pos <= nh THEN 'hidden' WHEN pos - nh <= rest - 2 * tenth THEN 'train'
   WHEN pos - nh <= rest - tenth THEN 'val' ELSE 'test' END AS split FROM tenths)"""

FREQ = MASKED + """,
typed AS (SELECT s.*, n.entity_type AS source_type FROM split s JOIN entities n ON n.domain = s.domain AND n.id = s.src),
ft AS (SELECT domain, source_type, et, dst, count(*) AS c FROM typed WHERE split = 'train' GROUP BY ALL)"""


def _h(n: str) -> str:
    return (
        f"(CASE WHEN {n} < 32 THEN coalesce(list_sum(list_transform(range(1, ({n})::BIGINT + 1), lambda i: 1.0::DOUBLE / i)), 0.0) "
        f"ELSE ln({n}) + 0.5772156649015329 + 1.0::DOUBLE / (2 * ({n})) - 1.0::DOUBLE / (12.0::DOUBLE * ({n}) * ({n})) "
        f"+ 1.0::DOUBLE / (120.0::DOUBLE * ({n}) * ({n}) * ({n}) * ({n})) END)"
    )


FREQ_RANKS = FREQ + f""",
levels AS (SELECT domain, source_type, et, c, count(*) AS m FROM ft GROUP BY ALL),
stacked AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY domain, source_type, et ORDER BY c DESC
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM levels),
seen AS (SELECT domain, source_type, et, count(*) AS seen FROM ft GROUP BY ALL),
vn AS (SELECT domain, count(*) AS nv FROM entities GROUP BY domain),
ranks AS (SELECT t.domain, nv, coalesce(s.above, seen, 0)::DOUBLE AS g, coalesce(s.m, nv - coalesce(seen, 0))::DOUBLE AS e
  FROM typed t LEFT JOIN ft USING (domain, source_type, et, dst)
  LEFT JOIN stacked s ON s.domain = t.domain AND s.source_type = t.source_type AND s.et = t.et AND s.c = ft.c
  LEFT JOIN seen ON seen.domain = t.domain AND seen.source_type = t.source_type AND seen.et = t.et
  JOIN vn ON vn.domain = t.domain WHERE t.split = 'test'),
fm AS (SELECT domain, avg(greatest(0, least(1, (least(10, nv - 1) - g) / e))) AS hits,
       avg(({_h('g + e')} - {_h('g')}) / e) AS mrr FROM ranks GROUP BY domain)"""

RANDOM = MASKED + f""",
vn AS (SELECT domain, count(*) AS nv FROM entities GROUP BY domain),
draws AS (SELECT s.domain, nv, ('0x' || substr(md5(concat_ws('|', '42', 'rank', s.domain, src, dst, et, copy)), 1, 15))::BIGINT % nv + 1 AS rank
          FROM split s JOIN vn ON vn.domain = s.domain WHERE split = 'test'),
rm AS (SELECT domain, avg(CASE WHEN rank <= least(10, nv - 1) THEN 1.0::DOUBLE ELSE 0.0 END) AS hits, avg(1.0::DOUBLE / rank) AS mrr,
       any_value(least(10, nv - 1) / nv) AS expected_hits, any_value({_h('nv')} / nv) AS expected_mrr FROM draws GROUP BY domain)"""

RANKED = """own AS (SELECT o_orderkey, domain FROM od),
ranked AS (SELECT domain, 'order:'||l_orderkey AS src, 'part:'||l_partkey AS dst, 'explains' AS et, -l_extendedprice AS pos
           FROM lineitem JOIN own ON l_orderkey = o_orderkey),
hidden AS (SELECT domain, src, dst, et FROM split WHERE split = 'hidden'),
truth AS (SELECT DISTINCT domain, src, dst, et FROM hidden),
firsts AS (SELECT domain, src, dst, et, min(pos) AS pos FROM ranked GROUP BY ALL),
placed_r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY pos, src, dst, et) AS place FROM firsts),
cuts AS (SELECT unnest([5, 10, 20]) AS n),
graphs AS (SELECT DISTINCT domain FROM edges)"""


def region_split(spark, d):
    entities, edges = region_kg(spark, d)
    return entities, edges, mask_split(edges, KEYS)


@query("L1_mask_split", with_kg("SELECT * FROM split", MASKED))
def masked(spark, d):
    return region_split(spark, d)[2]


@query("L2_kg_split", with_kg("SELECT * FROM split", FOUR))
def four_way(spark, d):
    return kg_split(region_kg(spark, d)[1], KEYS)


@query(
    "P7_train_graph",
    with_kg("SELECT domain, src, dst, et, count(*) AS n FROM split WHERE split = 'train' GROUP BY ALL", FOUR),
)
def training(spark, d):
    kept = train_graph(kg_split(region_kg(spark, d)[1], KEYS), KEYS)
    return kept.groupBy("domain", "src", "dst", "et").agg(F.count("*").alias("n"))


@query("L3_freq_table", with_kg("SELECT * FROM ft", FREQ))
def frequencies(spark, d):
    entities, _, split = region_split(spark, d)
    return R.freq_table(split.filter("split = 'train'"), entities, KEYS)


@query("L4_hits_frequency", rounded("hits", with_kg("SELECT domain, hits FROM fm", FREQ_RANKS)))
def hits_frequency(spark, d):
    entities, _, split = region_split(spark, d)
    return R.frequency_metrics(pin(split), entities, KEYS).select("domain", "hits")


@query("L5_mrr_frequency", rounded("mrr", with_kg("SELECT domain, mrr FROM fm", FREQ_RANKS)))
def mrr_frequency(spark, d):
    entities, _, split = region_split(spark, d)
    return R.frequency_metrics(pin(split), entities, KEYS).select("domain", "mrr")


@query(
    "L6_hits_random",
    rounded("hits, expected_hits", with_kg("SELECT domain, hits, expected_hits FROM rm", RANDOM)),
)
def hits_random(spark, d):
    entities, _, split = region_split(spark, d)
    return R.random_metrics(split, entities, KEYS).select("domain", "hits", "expected_hits")


@query(
    "L7_mrr_random",
    rounded("mrr, expected_mrr", with_kg("SELECT domain, mrr, expected_mrr FROM rm", RANDOM)),
)
def mrr_random(spark, d):
    entities, _, split = region_split(spark, d)
    return R.random_metrics(split, entities, KEYS).select("domain", "mrr", "expected_mrr")


# ------------------------------------------------------------------- backtests


def ranked_and_hidden(spark, d):
    """Order–part lines by price against the hidden tenth of each region's edges."""
    _, edges = region_kg(spark, d)
    hidden = kg_split(edges, KEYS).filter("split = 'hidden'").select("domain", "src", "dst", "et")
    nation = table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    orders = (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", F.col("r_name").alias("domain"))
    )
    ranked = (
        table(spark, d, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "domain",
            F.concat(F.lit("order:"), "l_orderkey").alias("src"),
            F.concat(F.lit("part:"), "l_partkey").alias("dst"),
            F.lit("explains").alias("et"),
            (-F.col("l_extendedprice")).alias("pos"),
        )
    )
    return ranked, pin(hidden)


BT = """SELECT g.domain, c.n, coalesce(h.hits / h.shown, 0.0) AS precision, coalesce(h.hits / t.n_hidden, 0.0) AS recall,
  p.n_proposals, t.n_hidden, m.n_matched
FROM graphs g CROSS JOIN cuts c
LEFT JOIN (SELECT p.domain, c.n, count(*) AS shown, count(t.src) AS hits FROM placed_r p JOIN cuts c ON p.place <= c.n
   LEFT JOIN truth t USING (domain, src, dst, et) GROUP BY ALL) h ON h.domain = g.domain AND h.n = c.n
JOIN (SELECT domain, count(*) AS n_hidden FROM truth GROUP BY domain) t ON t.domain = g.domain
JOIN (SELECT domain, count(*) AS n_proposals FROM ranked GROUP BY domain) p ON p.domain = g.domain
JOIN (SELECT domain, count(*) AS n_matched FROM firsts SEMI JOIN truth USING (domain, src, dst, et) GROUP BY domain) m ON m.domain = g.domain"""


@query("L18_backtest", rounded("precision, recall", with_kg(BT, f"{FOUR}, {RANKED}")))
def backtest(spark, d):
    return R.backtest(*ranked_and_hidden(spark, d), KEYS)


@query(
    "L16_precision_at_n",
    rounded("precision", with_kg(f"SELECT domain, n, precision FROM ({BT})", f"{FOUR}, {RANKED}")),
)
def precision(spark, d):
    return R.backtest(*ranked_and_hidden(spark, d), KEYS).select("domain", "n", "precision")


@query(
    "L17_recall_at_n",
    rounded("recall", with_kg(f"SELECT domain, n, recall FROM ({BT})", f"{FOUR}, {RANKED}")),
)
def recall(spark, d):
    return R.backtest(*ranked_and_hidden(spark, d), KEYS).select("domain", "n", "recall")


@query(
    "J4_backtest_match",
    rounded(
        "pos",
        with_kg(
            "SELECT * FROM firsts SEMI JOIN truth USING (domain, src, dst, et)", f"{FOUR}, {RANKED}"
        ),
    ),
)
def matches(spark, d):
    return R.matched_triples(*ranked_and_hidden(spark, d), KEYS)


@query(
    "W2_first_occurrence",
    rounded(
        "pos",
        with_kg("SELECT * FROM placed_r WHERE place <= 50", f"{FOUR}, {RANKED}"),
    ),
)
def first_seen(spark, d):
    return R.first_occurrences(ranked_and_hidden(spark, d)[0], KEYS, 50)


SOFT = """SELECT g.domain, c.n, coalesce(sp.v, 0.0) AS soft_precision, coalesce(sr.v, 0.0) AS soft_recall, p.n_proposals, t.n_hidden
FROM graphs g CROSS JOIN cuts c
LEFT JOIN (SELECT p.domain, c.n, avg(CASE WHEN EXISTS (SELECT 1 FROM hidden h WHERE h.domain = p.domain AND h.src = p.src AND h.et = p.et)
    OR EXISTS (SELECT 1 FROM hidden h WHERE h.domain = p.domain AND h.et = p.et AND h.dst = p.dst) THEN 1.0::DOUBLE ELSE 0.0 END) AS v
    FROM placed_r p JOIN cuts c ON p.place <= c.n GROUP BY ALL) sp ON sp.domain = g.domain AND sp.n = c.n
LEFT JOIN (SELECT h.domain, c.n, avg(CASE WHEN EXISTS (SELECT 1 FROM placed_r p WHERE p.place <= c.n AND h.domain = p.domain AND h.src = p.src AND h.et = p.et)
    OR EXISTS (SELECT 1 FROM placed_r p WHERE p.place <= c.n AND h.domain = p.domain AND h.et = p.et AND h.dst = p.dst) THEN 1.0::DOUBLE ELSE 0.0 END) AS v
    FROM hidden h CROSS JOIN cuts c GROUP BY ALL) sr ON sr.domain = g.domain AND sr.n = c.n
JOIN (SELECT domain, count(*) AS n_hidden FROM hidden GROUP BY domain) t ON t.domain = g.domain
JOIN (SELECT domain, count(*) AS n_proposals FROM ranked GROUP BY domain) p ON p.domain = g.domain"""


@query(
    "L19_soft_backtest",
    rounded("soft_precision, soft_recall", with_kg(SOFT, f"{FOUR}, {RANKED}")),
)
def soft_backtest(spark, d):
    return R.soft_backtest(*ranked_and_hidden(spark, d), KEYS)


@query(
    "J5_soft_match",
    with_kg(
        """SELECT f.domain, f.src, f.dst, f.et, (a.src IS NOT NULL OR b.dst IS NOT NULL) AS soft FROM firsts f
           LEFT JOIN (SELECT DISTINCT domain, src, et FROM hidden) a USING (domain, src, et)
           LEFT JOIN (SELECT DISTINCT domain, et, dst FROM hidden) b ON b.domain = f.domain AND b.et = f.et AND b.dst = f.dst""",
        f"{FOUR}, {RANKED}",
    ),
)
def soft_match(spark, d):
    ranked, hidden = ranked_and_hidden(spark, d)
    triples = ranked.select("domain", "src", "dst", "et").distinct()
    return R.soft_flags(triples, hidden, KEYS).select("domain", "src", "dst", "et", "soft")


# ------------------------------------------------------------ given embeddings

VEC_SQL = """vec AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
rel_long AS (SELECT label AS et, i, avg(v[i + 1]) AS x FROM vec, range(0, 64) t(i) GROUP BY label, i),
rel AS (SELECT et, list(x ORDER BY i) AS r FROM rel_long GROUP BY et),
trip AS (SELECT * FROM (SELECT id AS src, label AS et, lead(id) OVER (PARTITION BY label ORDER BY id) AS dst FROM vec) WHERE dst IS NOT NULL)"""

_RE = "(s[2*i+1]*{c} - s[2*i+2]*{n})"
_IM = "(s[2*i+1]*{n} + s[2*i+2]*{c})"


def _score_sql(model: str) -> str:
    if model == "distmult":
        return "list_sum(list_transform(range(1, 65), lambda i: s[i]*r[i]*t[i]))"
    if model == "transe":
        return "-list_sum(list_transform(range(1, 65), lambda i: abs(s[i]+r[i]-t[i])))"
    if model == "rotate":
        re = _RE.format(c="cos(r[i+1])", n="sin(r[i+1])")
        im = _IM.format(c="cos(r[i+1])", n="sin(r[i+1])")
        return f"-list_sum(list_transform(range(0, 32), lambda i: abs({re}-t[2*i+1]) + abs({im}-t[2*i+2])))"
    re = _RE.format(c="r[2*i+1]", n="r[2*i+2]")
    im = _IM.format(c="r[2*i+1]", n="r[2*i+2]")
    return f"list_sum(list_transform(range(0, 32), lambda i: {re}*t[2*i+1] + {im}*t[2*i+2]))"


def _scores_cte(model: str) -> str:
    return f"""heads AS (SELECT DISTINCT trip.src, trip.et, a.v AS s, rel.r FROM trip JOIN vec a ON a.id = trip.src JOIN rel USING (et)),
all_scores AS (SELECT src, et, id, round({_score_sql(model)}, 9) AS score FROM (SELECT src, et, s, r, b.id, b.v AS t FROM heads CROSS JOIN vec b)),
rank AS (SELECT trip.src, trip.et, trip.dst, 1 + count(*) FILTER (WHERE o.score > own.score OR (o.score = own.score AND o.id < trip.dst)) AS rank
  FROM trip JOIN all_scores own ON own.src = trip.src AND own.et = trip.et AND own.id = trip.dst
  JOIN all_scores o ON o.src = trip.src AND o.et = trip.et GROUP BY trip.src, trip.et, trip.dst)"""


def vector_graph(spark, d):
    """Given vectors as entities, label means as relations, next-of-label as triples."""
    raw = table(spark, d, "embeddings")
    graph = F.lit("embeddings").alias("domain")
    vectors = raw.select(
        graph, F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")
    )
    width = 64
    relations = (
        raw.groupBy(F.col("label").alias("et"))
        .agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(width)]).alias("vec"))
        .select(graph, "et", "vec")
    )
    nxt = F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id"))
    triples = (
        raw.select(graph, F.col("vec_id").alias("src"), F.col("label").alias("et"), nxt.alias("dst"))
        .filter("dst IS NOT NULL")
    )
    return vectors, relations, triples


def _register_scores() -> None:
    for n, model in enumerate(E.MODELS, start=8):
        label = {"distmult": "distmult", "transe": "transe", "rotate": "rotate", "complex": "complex"}[model]

        def scored(spark, d, model=model):
            vectors, relations, triples = vector_graph(spark, d)
            if model == "rotate":
                relations = relations.withColumn("vec", F.slice("vec", 1, 32))
            return E.score_triples(triples, vectors, relations, KEYS, model).drop("domain")

        query(
            f"L{n}_score_{label}",
            rounded(
                "score",
                f"WITH {VEC_SQL} SELECT src, et, dst, {_score_sql(model)} AS score FROM "
                "(SELECT trip.src, trip.et, trip.dst, a.v AS s, rel.r, b.v AS t FROM trip JOIN vec a ON a.id = trip.src "
                "JOIN rel USING (et) JOIN vec b ON b.id = trip.dst)",
            ),
        )(scored)


_register_scores()


@query(
    "J9_candidate_targets",
    f"WITH {VEC_SQL}, {_scores_cte('transe')} SELECT src, et, dst, rank FROM rank",
)
def candidate_ranks(spark, d):
    vectors, relations, triples = vector_graph(spark, d)
    return E.target_ranks(triples, vectors, relations, KEYS, "transe").select(
        "src", "et", "dst", "rank"
    )


def _all_models(column: str) -> str:
    parts = []
    for model in E.MODELS:
        parts.append(
            f"SELECT * FROM (WITH {_scores_cte(model)} SELECT '{model}' AS model, "
            f"avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0.0 END) AS hits, avg(1.0::DOUBLE / rank) AS mrr FROM rank)"
        )
    return rounded(column, f"WITH {VEC_SQL} SELECT model, {column} FROM ({' UNION ALL '.join(parts)})")


def model_metrics(spark, d):
    vectors, relations, triples = vector_graph(spark, d)
    out = None
    for model in E.MODELS:
        rel = relations.withColumn("vec", F.slice("vec", 1, 32)) if model == "rotate" else relations
        ranks = E.target_ranks(triples, vectors, rel, KEYS, model)
        part = R.rank_metrics(ranks, KEYS).withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    return out


@query("L13_hits_at_k", _all_models("hits"))
def hits_at_k(spark, d):
    return model_metrics(spark, d).select("model", "hits")


@query("L14_mrr", _all_models("mrr"))
def mrr(spark, d):
    return model_metrics(spark, d).select("model", "mrr")


@query(
    "K8_top_k_targets",
    rounded(
        "score",
        f"""WITH {VEC_SQL}, {_scores_cte('distmult')}
        SELECT src, et, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY src, et ORDER BY score DESC, id) AS place FROM all_scores)
        WHERE place <= 10""",
    ),
)
def top_targets(spark, d):
    vectors, relations, triples = vector_graph(spark, d)
    return E.top_targets(triples, vectors, relations, KEYS, "distmult").select(
        "src", "et", "id", "score", "place"
    )


@query("L12_kge_train")
def kge_train(spark, d):
    """Every model on the whole region graphs at full parameters: loss per epoch."""
    entities, edges = region_kg(spark, d)
    split = pin(mask_split(edges, KEYS))
    _, _, losses = TR.train_models(train_graph(split, KEYS), entities, KEYS, losses_only=True)
    return losses
