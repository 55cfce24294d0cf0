"""Text heuristics on documents, labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.catalog.derive import region_kg, with_kg
from edgeloom.catalog.registry import query, rounded, table
from edgeloom.functions import text as T
from edgeloom.operators import experiments as X

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
DOCS_SQL = f"""docs AS (SELECT doc_id AS id, lang, text AS claim, source || ' ' || lang || ' ' || text AS justification, text AS falsification_condition FROM documents),
ws AS (SELECT id, lang, list_filter(regexp_split_to_array(claim, '{WS}'), lambda w: w <> '') AS a,
   list_filter(regexp_split_to_array(justification, '{WS}'), lambda w: w <> '') AS b FROM docs)"""


def docs(spark, d):
    """Documents as proposals: the text is claim and condition, its origin precedes it as justification."""
    t = F.col("text")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "lang", t.alias("claim"),
        F.concat_ws(" ", "source", "lang", t).alias("justification"), t.alias("falsification_condition"),
    )


def _spec(w: str, n: int) -> str:
    return f"len(list_filter({w}, lambda w: length(w) > {n} OR regexp_matches(w, '\\p{{Nd}}')))"


def _quality(w: str) -> str:
    return (
        f"CASE WHEN len({w}) > 0 THEN 0.6 * (1 - exp(-len({w}) / 15.0::DOUBLE)) + 0.4 * least({_spec(w, 8)} / greatest(len({w}), 1) * 3.0, 1.0) ELSE 0 END"
    )


def _frac(key: str) -> str:
    return f"('0x' || substr(sha256({key} || ':42'), 1, 8))::BIGINT / 4294967295.0::DOUBLE"


@query(
    "T1_proxy_score",
    rounded(
        "score",
        f"""WITH {DOCS_SQL} SELECT id, greatest(0, least(1, 0.55 * ({_quality('a')}) + 0.45 * ({_quality('b')}) + {_frac('id::VARCHAR')} * 0.1 - 0.05)) AS score FROM ws""",
    ),
)
def proxy(spark, d):
    """Scores before the operator's rounding to six digits."""
    return docs(spark, d).select("id", T.proxy_score(digits=None).alias("score"))


@query(
    "T2_rubric_score",
    rounded(
        "score",
        "WITH " + DOCS_SQL + " SELECT id, criterion, greatest(1, least(5, 1 + 3 * (1 - exp(-len(w) / 12.0::DOUBLE)) + CASE WHEN len(w) > 0 THEN "
        + _spec("w", 7) + " / len(w) * 1.5 ELSE 0 END + " + _frac("id::VARCHAR || ':' || criterion")
        + " * 0.6 - 0.3)) AS score FROM (SELECT id, criterion, CASE WHEN criterion IN ('plausibility', 'relevance') THEN b ELSE a END AS w FROM ws, "
        "(SELECT unnest(['novelty', 'plausibility', 'specificity', 'testability', 'relevance']) AS criterion))",
    ),
)
def rubric(spark, d):
    """Scores before the operator's rounding to two digits."""
    return T.rubric_scores(docs(spark, d), digits=None).select("id", "criterion", "score")


MARK = "|".join(T.MARKERS)
FALS_SQL = f"""fs AS (SELECT id, lang, CASE WHEN len(w) > 0 THEN 0.6 / (1 + exp(-0.15::DOUBLE * (len(w) - 10))) + 0.4 * len(list_filter(w, lambda x: regexp_matches(x, '{MARK}'))) / len(w)
   ELSE 0 END AS score FROM (SELECT id, lang, list_filter(regexp_split_to_array(lower(claim), '{WS}'), lambda w: w <> '') AS w FROM docs))"""


@query("T3_falsification_score", rounded("score", f"WITH {DOCS_SQL}, {FALS_SQL} SELECT id, score FROM fs"))
def falsification(spark, d):
    return docs(spark, d).select("id", T.falsification_score(F.col("falsification_condition")).alias("score"))


@query(
    "E29_testability_fraction",
    rounded("fraction", f"WITH {DOCS_SQL}, {FALS_SQL} SELECT lang, avg((score >= 0.4)::INTEGER) AS fraction FROM fs GROUP BY lang"),
)
def testability(spark, d):
    score = T.falsification_score(F.col("falsification_condition"))
    return docs(spark, d).groupBy("lang").agg(F.avg((score >= 0.4).cast("double")).alias("fraction"))


REPLY_SQL = """replies AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5
   WHEN 0 THEN text || ' ```json {"novelty": ' || turn % 7 || ', "' || CASE WHEN turn % 2 = 0 THEN 'depth' ELSE 'width' END || '": 3} ``` end'
   WHEN 1 THEN text || ' {not json} {"novelty": ' || turn % 5 + 1 || ', "depth": {"x": 1}}'
   WHEN 2 THEN text WHEN 3 THEN '```json {broken} ```' || text || ' {"novelty": 2}'
   ELSE text || ' {"novelty": ' || turn % 6 || '.5, "depth": ' || turn % 3 + 1 || '}' END AS reply FROM conversations),
found AS (SELECT conv_id, turn, reply, CASE WHEN json_valid(fenced) THEN fenced WHEN json_valid(loose) THEN loose END AS j FROM (
  SELECT *, trim(regexp_replace(string_split(reply, '```')[2], '^json', '')) AS fenced, regexp_extract(reply, '(?s)\\{".*\\}', 0) AS loose FROM replies)),
flat AS (SELECT conv_id, turn, CASE WHEN json_valid(f) THEN f END AS j FROM (
  SELECT conv_id, turn, nullif(regexp_extract(reply, '\\{[^{}]*\\}', 0), '') AS f FROM replies))"""


def replies(spark, d):
    """Conversation turns with a model answer appended, fenced, inline, broken or absent."""
    kind = (F.col("conv_id") + F.col("turn")) % 5
    text = F.col("text")
    n = F.col("turn")
    second = F.when(n % 2 == 0, "depth").otherwise("width")
    return table(spark, d, "conversations").select(
        "conv_id", "turn",
        F.when(kind == 0, F.concat(text, F.lit(' ```json {"novelty": '), n % 7, F.lit(', "'), second, F.lit('": 3} ``` end')))
        .when(kind == 1, F.concat(text, F.lit(' {not json} {"novelty": '), n % 5 + 1, F.lit(', "depth": {"x": 1}}')))
        .when(kind == 2, text)
        .when(kind == 3, F.concat(F.lit("```json {broken} ```"), text, F.lit(' {"novelty": 2}')))
        .otherwise(F.concat(text, F.lit(' {"novelty": '), n % 6, F.lit('.5, "depth": '), n % 3 + 1, F.lit("}"))).alias("reply"),
    )


@query("T4_extract_json", f"WITH {REPLY_SQL} SELECT conv_id, turn, j AS json FROM found")
def extraction(spark, d):
    return T.extract_json(replies(spark, d), "reply").select("conv_id", "turn", "json")


@query(
    "T5_parse_scores",
    f"""WITH {REPLY_SQL}, s AS (SELECT *, trunc(try_cast(j ->> '$.novelty' AS DOUBLE)) AS a, trunc(try_cast(j ->> '$.depth' AS DOUBLE)) AS b FROM flat),
        e AS (SELECT *, CASE WHEN j IS NULL THEN 'no_json' WHEN a IS NULL OR b IS NULL THEN 'missing:' || concat_ws(',', CASE WHEN a IS NULL THEN 'novelty' END, CASE WHEN b IS NULL THEN 'depth' END)
          WHEN a NOT BETWEEN 1 AND 5 OR b NOT BETWEEN 1 AND 5 THEN 'range:' || concat_ws(',', CASE WHEN a NOT BETWEEN 1 AND 5 THEN 'novelty' END, CASE WHEN b NOT BETWEEN 1 AND 5 THEN 'depth' END) END AS error FROM s)
        SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN a::INTEGER END AS novelty, CASE WHEN error IS NULL THEN b::INTEGER END AS depth FROM e""",
)
def scores(spark, d):
    found = replies(spark, d).withColumn("json", T.flat_object(F.col("reply")))
    return T.parse_scores(found, "json", ["novelty", "depth"]).select("conv_id", "turn", "error", "novelty", "depth")


@query(
    "T6_prompt_sanitise",
    f"WITH {REPLY_SQL} SELECT conv_id, turn, substr(replace(reply, '```', ''), 1, 500) AS prompt FROM replies",
)
def sanitised(spark, d):
    return replies(spark, d).select("conv_id", "turn", T.prompt_sanitise(F.col("reply")).alias("prompt"))


@query(
    "T7_kg_context",
    with_kg(
        """SELECT domain, n_entities, n_edges, first_ids FROM (SELECT domain, count(*) AS n_entities FROM entities GROUP BY domain)
           JOIN (SELECT domain, count(*) AS n_edges FROM edges GROUP BY domain) USING (domain)
           JOIN (SELECT domain, string_agg(id, ',' ORDER BY id) AS first_ids FROM (SELECT domain, id FROM entities QUALIFY row_number() OVER (PARTITION BY domain ORDER BY id) <= 20)
                 GROUP BY domain) USING (domain)"""
    ),
)
def context(spark, d):
    entities, edges = region_kg(spark, d)
    return T.kg_context(entities, edges, ["domain"])


LABELS_SQL = """la AS (SELECT doc_id, 'quality' AS dimension, quality * 4 + 1 AS score FROM labels UNION ALL SELECT doc_id, 'toxic', 5 - toxic * 4 FROM labels),
lb AS (SELECT doc_id, dimension, (n_chars % 5 + 1)::INTEGER AS score FROM documents, (SELECT unnest(['quality', 'toxic']) AS dimension))"""


def judges(spark, d):
    """Labels as one judge on a 1–5 scale, text length as another."""
    dims = lambda q, t: F.inline(F.array(
        F.struct(F.lit("quality").alias("dimension"), q.alias("score")),
        F.struct(F.lit("toxic").alias("dimension"), t.alias("score")),
    ))
    a = table(spark, d, "labels").select("doc_id", dims(F.col("quality") * 4 + 1, 5 - F.col("toxic") * 4))
    length = (F.col("n_chars") % 5 + 1).cast("int")
    b = table(spark, d, "documents").select("doc_id", dims(length, length))
    return a, b


@query(
    "E27_rubric_summary",
    rounded(
        "mean",
        f"""WITH {LABELS_SQL} SELECT source, dimension, avg(score) AS mean, count(*) AS n FROM la JOIN documents USING (doc_id) GROUP BY ALL""",
    ),
)
def rubric_table(spark, d):
    a, _ = judges(spark, d)
    return X.rubric_summary(a.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id"), ["source"])


@query(
    "E28_judge_agreement",
    rounded(
        "agreement",
        f"""WITH {LABELS_SQL} SELECT dimension, avg((abs(la.score - lb.score) <= 1)::INTEGER) AS agreement, count(*) AS n FROM la JOIN lb USING (doc_id, dimension) GROUP BY dimension""",
    ),
)
def agreement(spark, d):
    return X.judge_agreement(*judges(spark, d), ["doc_id", "dimension"], ["dimension"])
