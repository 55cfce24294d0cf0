"""Archives, islands and top-k reports over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.catalog.registry import query, rounded, table
from edgeloom.operators import archive as A

KEYS = ["archive_id"]
BINS = 10

ITEMS_SQL = f"""items AS (SELECT o_orderpriority AS archive_id, o_orderkey AS seq, 'order:'||o_orderkey AS item, floor(o_totalprice / 10000) AS fitness,
  least({BINS - 1}, floor(greatest(0.0, least(1.0, o_totalprice / 500000.0::DOUBLE)) * {BINS}))::INTEGER AS row,
  least({BINS - 1}, floor((o_custkey % 97) / 97.0::DOUBLE * {BINS}))::INTEGER AS col, o_orderstatus AS st FROM orders),
old AS (SELECT archive_id, row, col, item, fitness FROM items WHERE st = 'O'
  QUALIFY row_number() OVER (PARTITION BY archive_id, row, col ORDER BY fitness DESC, seq) = 1),
merged AS (SELECT archive_id, row, col, item, fitness FROM (SELECT archive_id, row, col, item, fitness, -1 AS seq FROM old
  UNION ALL SELECT archive_id, row, col, item, fitness, seq FROM items WHERE st <> 'O')
  QUALIFY row_number() OVER (PARTITION BY archive_id, row, col ORDER BY fitness DESC, seq) = 1)"""


def items(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("archive_id"),
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("order:"), "o_orderkey").alias("item"),
        F.floor(F.col("o_totalprice") / 10000).cast("double").alias("fitness"),
        (F.col("o_totalprice") / 500000.0).alias("x"),
        ((F.col("o_custkey") % 97) / 97.0).alias("y"),
        F.col("o_orderstatus").alias("st"),
    )
    return A.place(rows, BINS, F.col("x"), F.col("y"))


def incumbents(spark, d):
    return A.archive_upsert(None, items(spark, d).filter("st = 'O'"), KEYS)


def merged(spark, d):
    return A.archive_upsert(incumbents(spark, d), items(spark, d).filter("st <> 'O'"), KEYS)


@query("E5_grid_bin", f"WITH {ITEMS_SQL} SELECT item, row, col FROM items")
def bins(spark, d):
    return items(spark, d).select("item", "row", "col")


@query("E6_archive_upsert", rounded("fitness", f"WITH {ITEMS_SQL} SELECT * FROM merged"))
def upsert(spark, d):
    return merged(spark, d)


@query(
    "E7_inserted_flag",
    f"""WITH {ITEMS_SQL} SELECT i.item, i.fitness > greatest(coalesce(max(i.fitness) OVER (PARTITION BY i.archive_id, i.row, i.col ORDER BY i.seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300), coalesce(o.fitness, -1e300)) AS inserted
        FROM (SELECT * FROM items WHERE st <> 'O') i LEFT JOIN old o ON o.archive_id = i.archive_id AND o.row = i.row AND o.col = i.col""",
)
def inserted(spark, d):
    batch = items(spark, d).filter("st <> 'O'")
    bucket = F.floor(F.col("seq") / 4096)
    return A.inserted_flags(incumbents(spark, d), batch, KEYS, bucket).select("item", "inserted")


@query(
    "E8_archive_stats",
    rounded(
        "best_fitness, mean_fitness",
        f"""WITH {ITEMS_SQL} SELECT archive_id, count(*) AS coverage, max(fitness) AS best_fitness, avg(fitness) AS mean_fitness,
            {BINS * BINS} AS total_cells FROM merged GROUP BY archive_id""",
    ),
)
def stats(spark, d):
    return A.archive_stats(merged(spark, d), items(spark, d), KEYS, BINS)


@query(
    "E9_archive_heatmap",
    rounded(
        "fitness",
        f"""WITH {ITEMS_SQL} SELECT a.archive_id, r.row, c.col, coalesce(m.fitness, -1) AS fitness FROM (SELECT DISTINCT archive_id FROM items) a
            CROSS JOIN (SELECT unnest(range(0, {BINS}))::INTEGER AS row) r CROSS JOIN (SELECT unnest(range(0, {BINS}))::INTEGER AS col) c
            LEFT JOIN merged m ON m.archive_id = a.archive_id AND m.row = r.row AND m.col = c.col""",
    ),
)
def heatmap(spark, d):
    """Every cell; empty ones (NaN in the operator) shown as −1."""
    grid = A.archive_heatmap(merged(spark, d), items(spark, d), KEYS, BINS)
    return grid.withColumn("fitness", F.nanvl("fitness", F.lit(-1.0)))


@query(
    "K1_top_cells",
    rounded(
        "fitness",
        f"""WITH {ITEMS_SQL} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY fitness DESC, row, col) AS place FROM merged)
            WHERE place <= 5""",
    ),
)
def top_cells(spark, d):
    return A.top_cells(merged(spark, d), KEYS, 5)


@query(
    "K2_top_proposals",
    rounded(
        "fitness",
        """SELECT lang, claim, fitness, id, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY fitness DESC, claim) AS place FROM (
           SELECT lang, text AS claim, max(n_chars)::DOUBLE AS fitness, max(doc_id) AS id FROM documents WHERE length(text) > 0 GROUP BY lang, text))
           WHERE place <= 5""",
    ),
)
def top_claims(spark, d):
    """Longest documents per language, exact copies shown once."""
    cells = table(spark, d, "documents").select(
        "lang", F.col("text").alias("claim"), F.col("n_chars").cast("double").alias("fitness"),
        F.col("doc_id").alias("id"),
    )
    return A.top_proposals(cells, ["lang"], 5)


MEMBERS_SQL = """members AS (SELECT o_orderpriority AS run, (o_custkey % 8)::INTEGER AS island, o_orderkey AS id, o_totalprice AS score FROM orders),
slots AS (SELECT run, island, (row_number() OVER (PARTITION BY run, island ORDER BY score DESC, id) - 1) AS slot, id AS item FROM members)"""


def members(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("run"), (F.col("o_custkey") % 8).cast("int").alias("island"),
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"),
    )


def slots(spark, d):
    best = A.survivors(members(spark, d), ["run"], 5)
    return best.select("run", "island", (F.col("place") - 1).cast("long").alias("slot"), F.col("id").alias("item"))


@query(
    "K6_survivors",
    rounded("score", f"WITH {MEMBERS_SQL} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY score DESC, id) AS place FROM members) WHERE place <= 5"),
)
def survivors(spark, d):
    return A.survivors(members(spark, d), ["run"], 5)


@query(
    "K3_island_redistribute",
    f"""WITH {MEMBERS_SQL}, ranked AS (SELECT run, item, row_number() OVER (PARTITION BY run ORDER BY score, item) - 1 AS rank
          FROM (SELECT o_orderpriority AS run, c_custkey + 1000000000 AS item, sum(o_totalprice) AS score FROM orders JOIN customer ON o_custkey = c_custkey
                GROUP BY ALL)),
        both_s AS (SELECT run, (rank % 8)::INTEGER AS island, -rank - 1 AS ord, item FROM ranked
          UNION ALL SELECT run, island, slot, item FROM slots WHERE slot < 5)
        SELECT * FROM (SELECT run, island, item, row_number() OVER (PARTITION BY run, island ORDER BY ord) - 1 AS slot FROM both_s) WHERE slot < 5""",
)
def redistribute(spark, d):
    """All customers of a run, by value, dealt over eight islands."""
    from pyspark.sql import Window

    totals = (
        table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("o_orderpriority").alias("run"), (F.col("c_custkey") + 1000000000).alias("item"))
        .agg(F.sum("o_totalprice").alias("score"))
    )
    place = F.row_number().over(Window.partitionBy("run").orderBy("score", "item"))
    ranked = totals.withColumn("rank", place - 1)
    return A.island_redistribute(ranked, slots(spark, d), ["run"], 8).select("run", "island", "item", "slot")


@query(
    "K4_ring_migration",
    f"""WITH {MEMBERS_SQL}, moved AS (SELECT run, ((island + 1) % 8)::INTEGER AS island, -1 AS ord, item FROM slots WHERE slot = 0
          UNION ALL SELECT run, island, slot, item FROM slots WHERE slot < 5)
        SELECT * FROM (SELECT run, island, item, row_number() OVER (PARTITION BY run, island ORDER BY ord) - 1 AS slot FROM moved) WHERE slot < 5""",
)
def migrate(spark, d):
    return A.ring_migration(slots(spark, d), ["run"], 8).select("run", "island", "item", "slot")


@query(
    "K5_ring_migration_replace_worst",
    rounded(
        "score",
        f"""WITH {MEMBERS_SQL}, best AS (SELECT run, island, id, score FROM members QUALIFY row_number() OVER (PARTITION BY run, island ORDER BY score DESC, id DESC) = 1),
            worst AS (SELECT run, island, id, score FROM members QUALIFY row_number() OVER (PARTITION BY run, island ORDER BY score, id) = 1),
            moves AS (SELECT b.run, w.island, b.id AS new_id, b.score AS new_score, w.id AS old_id FROM best b
              JOIN worst w ON w.run = b.run AND w.island = (b.island + 1) % 8 WHERE b.score > w.score)
            SELECT run, island, count(*) AS n, max(score) AS best_score, sum(score) / 1e4 AS score FROM (
              SELECT m.* FROM members m ANTI JOIN moves v ON v.run = m.run AND v.island = m.island AND v.old_id = m.id
              UNION ALL SELECT run, island, new_id, new_score FROM moves) GROUP BY run, island""",
    ),
)
def replace_worst(spark, d):
    rows = members(spark, d)
    after = A.ring_migration_replace_worst(rows, rows.select("run", "island").distinct(), ["run"])
    return after.groupBy("run", "island").agg(
        F.count("*").alias("n"), F.max("score").alias("best_score"), (F.sum("score") / 1e4).alias("score")
    )


@query(
    "K7_exemplar_sample",
    """SELECT archive_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY md5(concat_ws('|', '42', id)), id) AS place FROM (
       SELECT DISTINCT o_orderpriority AS archive_id, 'customer:'||o_custkey AS id FROM orders WHERE o_custkey % 8 <> 3)) WHERE place <= 7""",
)
def exemplars(spark, d):
    cells = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("archive_id"), (F.col("o_custkey") % 8).alias("island"),
        F.concat(F.lit("customer:"), "o_custkey").alias("id"),
    )
    return A.exemplar_sample(cells, KEYS, 7, exclude_island=3)


@query(
    "E30_island_best",
    rounded(
        "best_score, global_best",
        f"""WITH {MEMBERS_SQL} SELECT run, island, id AS best_id, score AS best_score, g AS global_best FROM (
            SELECT *, max(score) OVER (PARTITION BY run) AS g FROM members) QUALIFY row_number() OVER (PARTITION BY run, island ORDER BY score DESC, id DESC) = 1""",
    ),
)
def best(spark, d):
    rows = members(spark, d)
    return A.island_best(rows, ["run"]).join(A.global_best(rows, ["run"]), "run")


@query(
    "W6_recent_k",
    """SELECT user_id, text, pos, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC, text) AS place FROM (
       SELECT user_id, props AS text, max(event_id) AS pos FROM events WHERE event_type = 'error' GROUP BY ALL)) WHERE place <= 10""",
)
def recent(spark, d):
    failures = table(spark, d, "events").filter("event_type = 'error'").select(
        "user_id", F.col("props").alias("text"), F.col("event_id").alias("pos")
    )
    return A.recent_k(failures, ["user_id"], 10)
