"""Streams over the event table and over archive items."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.catalog.archives import ITEMS_SQL, KEYS, items
from edgeloom.catalog.registry import query, rounded, table
from edgeloom.catalog.storage import scratch
from edgeloom.streaming import incremental as S


@query(
    "X1_stream_funnel",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'purchase') AS evaluated,
       count(*) FILTER (WHERE event_type = 'error') AS rejected FROM events GROUP BY 1""",
)
def funnel(spark, d):
    """The event table as a file stream; days are appended once the watermark has passed them.

    A last row far enough ahead, of a type that is not counted, makes every day final;
    it arrives in a second run, which goes on from the checkpoint of the first.
    """
    path, out, state = scratch(spark), scratch(spark), scratch(spark)
    kind = F.col("event_type")
    rows = table(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "purchase", "candidate_evaluated").when(kind == "error", "candidate_rejected").otherwise("other").alias("event_type"),
    )
    rows.write.parquet(path)
    ahead = F.max("ts") + F.expr("INTERVAL 4 DAYS")
    closing = rows.agg(ahead.alias("ts")).withColumn("event_type", F.lit("other"))

    def run() -> None:
        stream = S.read_event_stream(spark, path, rows.schema, files_per_trigger=1 << 30)
        S.append_files(S.stream_funnel(stream, "ts"), out, state)

    run()
    closing.write.mode("append").parquet(path)
    run()
    days = spark.read.schema("start timestamp, evaluated long, rejected long").parquet(out)
    return days.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "evaluated", "rejected")


@query(
    "X2_stream_archive",
    rounded(
        "fitness",
        f"""WITH {ITEMS_SQL} SELECT archive_id, row, col, fitness, item FROM items
            QUALIFY row_number() OVER (PARTITION BY archive_id, row, col ORDER BY fitness DESC, seq) = 1""",
    ),
)
def archive(spark, d):
    """Items as a file stream, merged batch by batch into an archive of files."""
    path, out, state = scratch(spark), scratch(spark), scratch(spark)
    rows = items(spark, d).select("archive_id", "row", "col", "fitness", "item", "seq")
    rows.repartition(3).write.parquet(path)
    S.stream_archive(S.read_event_stream(spark, path, rows.schema), KEYS, out, state)
    return S.read_archive(spark, out).drop("seq")
