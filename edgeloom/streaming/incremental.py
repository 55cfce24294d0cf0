"""Incremental forms of the funnel and of the best-per-cell archive, into files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """New files of an append-only folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_funnel(events: DataFrame, time: str, width: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Evaluated and rejected candidates per time window, with a bound on lateness."""
    return (
        events.withWatermark(time, lateness)
        .groupBy(F.window(time, width).alias("w"))
        .agg(
            F.count_if(F.col("event_type") == "candidate_evaluated").alias("evaluated"),
            F.count_if(F.col("event_type") == "candidate_rejected").alias("rejected"),
        )
        .select(F.col("w.start").alias("start"), "evaluated", "rejected")
    )


def append_files(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Append what is final of the data present now; a restart goes on after the last whole batch.

    A window is final, and leaves the state, once the watermark has passed its
    end; rows later than the watermark are dropped.
    """
    running = (
        stream.writeStream.outputMode("append").format("parquet").option("path", folder)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    running.awaitTermination()


def best_per_cell(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best item per cell; ties go to the smaller ``seq``."""
    order = F.struct("fitness", -F.col("seq"))
    return items.groupBy(*keys, "row", "col").agg(
        F.max_by(F.struct("fitness", "item", "seq"), order).alias("b")
    ).select(*keys, "row", "col", "b.fitness", "b.item", "b.seq")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Batches whose archive was written to its end, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    if fs.exists(root):
        for status in fs.listStatus(root):
            path = status.getPath()
            done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
            if path.getName().startswith("batch=") and fs.exists(done):
                found.append(int(path.getName().split("=")[1]))
    return sorted(found)


def read_archive(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest whole archive (of a batch earlier than ``before``); None if there is none."""
    usable = [v for v in _versions(spark, folder) if before is None or v < before]
    return spark.read.parquet(f"{folder}/batch={usable[-1]}") if usable else None


def merge_into_archive(folder: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that merges new items into the archive of the batch before.

    Batch ``n`` always reads the newest archive below ``n`` and writes that of
    ``n``, so a batch that is run again gives the same table.  The archive has
    one row per cell; the two latest versions stay.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = best_per_cell(batch, keys)
        old = read_archive(spark, folder, before=number)
        if old is not None:
            rows = best_per_cell(rows.unionByName(old), keys)
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        for stale in [v for v in _versions(spark, folder) if v < number][:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={stale}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return merge


def stream_archive(items: DataFrame, keys: Sequence[str], folder: str, checkpoint: str) -> None:
    """Merge the items present now into the archive under ``folder``.

    Descriptors must not depend on the batch.
    """
    running = (
        items.writeStream.foreachBatch(merge_into_archive(folder, keys))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    running.awaitTermination()
