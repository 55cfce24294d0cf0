"""JSON checkpoints, archives, event logs, run folders and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, types as T
from pyspark.sql import functions as F

from edgeloom.schema import ARCHIVE_CELL, PROPOSAL

CELL_COLUMNS = ["archive_id", "row", "col", "fitness", "item"]

ARCHIVE_DOCUMENT = T.StructType(
    [
        T.StructField("num_bins", T.IntegerType()),
        T.StructField("archive_id", T.StringType()),
        T.StructField("cells", T.MapType(T.StringType(), ARCHIVE_CELL)),
    ]
)
CHECKPOINT = T.StructType(
    [
        T.StructField("experiment_id", T.StringType()),
        T.StructField("generation", T.IntegerType()),
        T.StructField("no_improve_count", T.IntegerType()),
        T.StructField("best_gain", T.DoubleType()),
        T.StructField("islands", T.MapType(T.StringType(), T.ArrayType(PROPOSAL))),
        T.StructField("archive", ARCHIVE_DOCUMENT),
    ]
)
EVENT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
    ]
)


def archive_rows(docs: DataFrame, column: str = "archive") -> DataFrame:
    """Cells of archive documents; malformed keys and out-of-range cells are dropped."""
    cells = docs.select(
        F.coalesce(F.col(f"{column}.archive_id"), F.lit("primary")).alias("archive_id"),
        F.col(f"{column}.num_bins").alias("_bins"),
        F.explode(f"{column}.cells").alias("_key", "_cell"),
    )
    part = F.split("_key", ",")
    return (
        cells.filter(F.size(part) == 2)
        .select(
            "archive_id", "_bins", part[0].try_cast("int").alias("row"), part[1].try_cast("int").alias("col"),
            F.col("_cell.fitness_signal").alias("fitness"), F.col("_cell.proposal").alias("item"),
        )
        .filter(
            F.col("row").between(0, F.col("_bins") - 1) & F.col("col").between(0, F.col("_bins") - 1)
            & F.col("fitness").isNotNull() & F.col("item").isNotNull()
        )
        .select(*CELL_COLUMNS)
    )


def archive_documents(archive: DataFrame, bins: int) -> DataFrame:
    """The inverse: one document per archive; a grid bounds its size."""
    entry = F.struct(
        F.concat_ws(",", "row", "col").alias("key"),
        F.struct(F.col("item").alias("proposal"), F.col("fitness").alias("fitness_signal")).alias("value"),
    )
    return archive.groupBy("archive_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("cells")
    ).select(F.struct(F.lit(bins).alias("num_bins"), "archive_id", "cells").alias("archive"))


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoints with defaults for whatever a file leaves out; corrupt files are dropped."""
    raw = spark.read.schema(CHECKPOINT).option("mode", "DROPMALFORMED").json(path)
    return raw.withColumns({
        "generation": F.coalesce("generation", F.lit(0)),
        "no_improve_count": F.coalesce("no_improve_count", F.lit(0)),
        "best_gain": F.coalesce("best_gain", F.lit(0.0)),
    })


def island_rows(checkpoints: DataFrame) -> DataFrame:
    """``(experiment_id, generation, island, slot, proposal)``."""
    return checkpoints.select(
        "experiment_id", "generation", F.explode("islands").alias("_island", "_items")
    ).select(
        "experiment_id", "generation", F.col("_island").try_cast("int").alias("island"),
        F.posexplode("_items").alias("slot", "proposal"),
    )


def write_checkpoints(checkpoints: DataFrame, path: str) -> None:
    """Overwrite in one commit: readers see the old or the new state."""
    checkpoints.write.mode("overwrite").json(path)


def keep_last(rows: DataFrame, keys: Sequence[str], generation: str, k: int) -> DataFrame:
    """The rows of the k latest generations per key."""
    latest = rows.select(*keys, generation).distinct()
    order = Window.partitionBy(*keys).orderBy(F.desc(generation))
    kept = latest.withColumn("_p", F.row_number().over(order)).filter(F.col("_p") <= k).drop("_p")
    return rows.join(kept, [*keys, generation], "left_semi")


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    """JSONL events; lines that are not JSON objects are skipped."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", EVENT, {"mode": "PERMISSIVE"})
    is_object = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    return lines.filter(is_object).select(parsed.alias("e")).select("e.*")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def discover_runs(spark: SparkSession, pattern: str, root: str, schema: str) -> DataFrame:
    """One row per summary file under ``root``; the run is its folder below it."""
    name = F.regexp_extract(F.col("_metadata.file_path"), f"{root}/(.+)/[^/]+$", 1)
    return spark.read.schema(schema).json(pattern).select(name.alias("run"), "*")


def read_seed_tables(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Per-seed CSV files as one long table with their ``seed``."""
    seed = F.regexp_extract(F.col("_metadata.file_path"), r"seed[_=](\d+)", 1).cast("int")
    return spark.read.schema(schema).option("header", True).csv(pattern).select("*", seed.alias("seed"))


def write_summary(df: DataFrame, path: str, form: str) -> None:
    """A small aggregated result as a single CSV or JSON file."""
    if form == "csv":
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    elif form == "json":
        df.coalesce(1).write.mode("overwrite").json(path)
    else:
        raise ValueError("form must be 'csv' or 'json'")
