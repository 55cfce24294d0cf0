"""Round trips through every file layout, on rows of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from edgeloom.catalog.archives import BINS, ITEMS_SQL, merged
from edgeloom.catalog.derive import region_kg, with_kg
from edgeloom.catalog.experiments import LOG_SQL, METRIC_SQL, RUNS_SQL, event_log, metric_table, runs
from edgeloom.catalog.registry import query, rounded, table
from edgeloom.operators.archive import survivors
from edgeloom.schema import PROPOSAL_FIELDS
from edgeloom.session import checkpoint_folder
from edgeloom.sources import documents as D
from edgeloom.sources import kg as K


def scratch(spark) -> str:
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"


def nation_kg(spark, d):
    """Suppliers and customers of each nation: many graphs of document size."""
    own = table(spark, d, "customer").select(
        F.concat(F.lit("nation"), "c_nationkey").alias("domain"), F.concat(F.lit("customer:"), "c_custkey").alias("src"),
        F.concat(F.lit("segment:"), "c_mktsegment").alias("dst"), F.lit("maps_to").alias("et"),
    )
    sup = table(spark, d, "supplier").select(
        F.concat(F.lit("nation"), "s_nationkey").alias("domain"), F.concat(F.lit("supplier:"), "s_suppkey").alias("src"),
        F.lit("segment:AUTOMOBILE").alias("dst"), F.lit("explains").alias("et"),
    )
    edges = own.unionByName(sup)
    nodes = edges.select("domain", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.withColumn("entity_type", F.substring_index("id", ":", 1)), edges


NATION_SQL = """e AS (SELECT 'nation' || c_nationkey AS domain, 'customer:' || c_custkey AS src, 'segment:' || c_mktsegment AS dst, 'maps_to' AS et FROM customer
  UNION ALL SELECT 'nation' || s_nationkey, 'supplier:' || s_suppkey, 'segment:AUTOMOBILE', 'explains' FROM supplier)"""


@query("S1_kg_read", f"WITH {NATION_SQL} SELECT domain, src, dst, et FROM e")
def kg_read(spark, d):
    """Edges read back from one JSON document per graph."""
    path = scratch(spark)
    K.write_kg_documents(*nation_kg(spark, d), path)
    return K.document_edges(spark.read.schema(K.KG_DOCUMENT).json(path)).select("domain", "src", "dst", "et")


@query(
    "S2_kg_write",
    f"""WITH {NATION_SQL} SELECT domain, count(*) AS n_entities, (SELECT count(*) FROM e x WHERE x.domain = v.domain) AS n_edges FROM (
        SELECT DISTINCT domain, id FROM (SELECT domain, src AS id FROM e UNION ALL SELECT domain, dst FROM e)) v GROUP BY domain""",
)
def kg_write(spark, d):
    docs = K.kg_documents(*nation_kg(spark, d), rows=20)
    return docs.groupBy("domain").agg(
        F.sum(F.size(F.coalesce("entities", F.array()))).alias("n_entities"),
        F.sum(F.size(F.coalesce("edges", F.array()))).alias("n_edges"),
    )


@query(
    "S2_kg_tables",
    with_kg("SELECT domain, et, count(*) AS n FROM edges GROUP BY ALL"),
)
def kg_tables(spark, d):
    """The whole region graphs through partitioned Parquet."""
    path = scratch(spark)
    K.write_kg_tables(*region_kg(spark, d), path)
    _, edges = K.read_kg_tables(spark, path)
    return edges.groupBy(F.col("domain").cast("string").alias("domain"), "et").agg(F.count("*").alias("n"))


def archive_table(spark, d):
    item = F.struct(*[(F.col("item") if f == "id" else F.lit(None).cast("string")).alias(f) for f in PROPOSAL_FIELDS])
    return merged(spark, d).withColumn("item", item)


def checkpoint_docs(spark, d):
    """One checkpoint per order priority and month: five best orders per island, and the archive."""
    proposal = F.struct(*[
        (F.concat(F.lit("order:"), "o_orderkey") if f == "id" else F.lit(None).cast("string")).alias(f) for f in PROPOSAL_FIELDS
    ])
    rows = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("experiment_id"), F.month("o_orderdate").alias("generation"),
        (F.col("o_custkey") % 4).cast("string").alias("island"), F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("score"), proposal.alias("proposal"),
    )
    per_island = survivors(rows, ["experiment_id", "generation"], 5).groupBy(
        "experiment_id", "generation", "island"
    ).agg(F.sort_array(F.collect_list("proposal")).alias("items"), F.max("score").alias("top"))
    islands = per_island.groupBy("experiment_id", "generation").agg(
        F.map_from_entries(F.collect_list(F.struct("island", "items"))).alias("islands"), F.max("top").alias("best_gain")
    )
    archives = D.archive_documents(archive_table(spark, d), BINS).withColumn("experiment_id", F.col("archive.archive_id"))
    return islands.join(archives, "experiment_id", "left")


CHECK_SQL = """cp AS (SELECT o_orderpriority AS experiment_id, month(o_orderdate)::INTEGER AS generation, (o_custkey % 4)::INTEGER AS island, o_orderkey, o_totalprice FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_orderpriority, month(o_orderdate), o_custkey % 4 ORDER BY o_totalprice DESC, o_orderkey) <= 5)"""


@query(
    "S5_checkpoint_read",
    f"WITH {CHECK_SQL} SELECT experiment_id, generation, island, 'order:' || o_orderkey AS id FROM cp",
)
def checkpoint_read(spark, d):
    path = scratch(spark)
    D.write_checkpoints(checkpoint_docs(spark, d), path)
    return D.island_rows(D.read_checkpoints(spark, path)).select(
        "experiment_id", "generation", "island", F.col("proposal.id").alias("id")
    )


@query(
    "S6_checkpoint_write",
    rounded(
        "best_gain",
        f"WITH {CHECK_SQL} SELECT experiment_id, generation, max(o_totalprice) AS best_gain, 0 AS no_improve_count, count(DISTINCT island) AS n_islands FROM cp GROUP BY ALL",
    ),
)
def checkpoint_write(spark, d):
    """Overwritten twice, read once; missing counters take their defaults."""
    path = scratch(spark)
    docs = checkpoint_docs(spark, d)
    D.write_checkpoints(docs.limit(1), path)
    D.write_checkpoints(docs, path)
    return D.read_checkpoints(spark, path).select(
        "experiment_id", "generation", "best_gain", "no_improve_count", F.size("islands").cast("long").alias("n_islands")
    )


@query(
    "S7_archive_read",
    rounded("fitness", f"WITH {ITEMS_SQL} SELECT archive_id, row, col, fitness, item FROM merged WHERE row < {BINS - 2} AND col < {BINS - 2}"),
)
def archive_read(spark, d):
    """Documents that claim a smaller grid and carry malformed keys lose those cells."""
    path = scratch(spark)
    docs = D.archive_documents(archive_table(spark, d), BINS - 2)
    docs.write.json(path)
    schema = D.T.StructType([D.T.StructField("archive", D.ARCHIVE_DOCUMENT)])
    read = spark.read.schema(schema).json(path)
    return D.archive_rows(read).select("archive_id", "row", "col", "fitness", F.col("item.id").alias("item"))


@query(
    "S8_archive_write",
    rounded("total", f"WITH {ITEMS_SQL} SELECT archive_id, {BINS} AS num_bins, count(*) AS n_cells, sum(fitness) AS total FROM merged GROUP BY archive_id"),
)
def archive_write(spark, d):
    docs = D.archive_documents(archive_table(spark, d), BINS)
    fitness = F.aggregate(F.map_values("archive.cells"), F.lit(0.0), lambda a, c: a + c["fitness_signal"])
    return docs.select(
        "archive.archive_id", "archive.num_bins", F.size("archive.cells").cast("long").alias("n_cells"), fitness.alias("total")
    )


def _log_files(spark, d) -> str:
    path = scratch(spark)
    log = event_log(spark, d)
    rows = log.select(
        F.col("pos").cast("string").alias("timestamp"), "event_type",
        F.to_json(F.struct("generation", "reason", "mean_gap")).alias("_p"),
    )
    good = F.concat(F.lit('{"timestamp":"'), "timestamp", F.lit('","event_type":"'), "event_type", F.lit('","payload":'), "_p", F.lit("}"))
    broken = F.when(F.col("timestamp").endswith("7"), F.lit("{oops")).when(F.col("timestamp").endswith("9"), F.lit("[1, 2]"))
    rows.select(F.coalesce(broken, good).alias("value")).write.text(path)
    return path


@query(
    "S9_event_scan",
    f"WITH {LOG_SQL} SELECT pos AS id, event_type, generation, reason FROM log WHERE pos % 10 NOT IN (7, 9)",
)
def event_scan(spark, d):
    """A log whose every tenth line is cut off and every other tenth is no object."""
    events = D.scan_events(spark, _log_files(spark, d))
    return events.select(
        F.col("timestamp").cast("long").alias("id"), "event_type", F.col("payload")["generation"].cast("int").alias("generation"),
        F.col("payload")["reason"].alias("reason"),
    )


@query(
    "S10_event_append",
    f"WITH {LOG_SQL} SELECT event_type, count(*) AS n, min(pos) AS first, max(pos) AS last FROM log GROUP BY event_type",
)
def event_append(spark, d):
    """Two appends, one scan."""
    path = scratch(spark)
    log = event_log(spark, d).select(
        F.col("pos").cast("string").alias("timestamp"), "event_type",
        F.create_map(F.lit("island"), F.col("island").cast("string")).alias("payload"),
    )
    D.append_events(log.filter("event_type = 'candidate_rejected'"), path)
    D.append_events(log.filter("event_type <> 'candidate_rejected'"), path)
    at = F.col("timestamp").cast("long")
    return D.scan_events(spark, path).groupBy("event_type").agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")
    )


@query(
    "S11_artifact_discovery",
    f"WITH {RUNS_SQL} SELECT 'run=' || grp || '/seed=' || seed AS run, count(*) AS n, count(*) FILTER (WHERE success) AS n_success FROM runs GROUP BY ALL",
)
def discovery(spark, d):
    """Run folders written by group and seed, found again by their paths."""
    path = scratch(spark)
    rows = runs(spark, d).select(F.col("grp").alias("run"), "seed", "run_id", "success")
    rows.repartition("run", "seed").write.partitionBy("run", "seed").json(path)
    found = D.discover_runs(spark, f"{path}/run=*/seed=*/*.json", path.split("/")[-1], "run_id long, success boolean")
    return found.groupBy(F.url_decode("run").alias("run")).agg(F.count("*").alias("n"), F.count_if("success").alias("n_success"))


@query(
    "S12_csv_seed_tables",
    rounded("price, volume", f"WITH {METRIC_SQL} SELECT domain, seed, price, volume FROM mt"),
)
def seed_tables(spark, d):
    path = scratch(spark)
    rows = metric_table(spark, d).select("domain", "price", "volume", "seed")
    rows.repartition("seed").write.partitionBy("seed").option("header", True).csv(path)
    return D.read_seed_tables(spark, f"{path}/seed=*/*.csv", "domain string, price double, volume double")


@query(
    "S13_csv_json_sinks",
    rounded("price", f"WITH {METRIC_SQL}, s AS (SELECT domain, avg(price) AS price, count(*) AS n FROM mt GROUP BY domain) SELECT 'csv' AS form, * FROM s UNION ALL SELECT 'json', * FROM s"),
)
def sinks(spark, d):
    path = scratch(spark)
    summary = metric_table(spark, d).groupBy("domain").agg(F.avg("price").alias("price"), F.count("*").alias("n"))
    schema = "domain string, price double, n long"
    out = None
    for form in ("csv", "json"):
        D.write_summary(summary, f"{path}-{form}", form)
        back = spark.read.schema(schema).option("header", True).format(form).load(f"{path}-{form}")
        part = back.select(F.lit(form).alias("form"), "domain", "price", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "S14_checkpoint_retention",
    """SELECT user_id, event_id FROM (SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY day(ts) DESC) AS p FROM events) WHERE p <= 3""",
)
def retention(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.dayofmonth("ts").alias("generation"))
    return D.keep_last(rows, ["user_id"], "generation", 3).select("user_id", "event_id")
