"""Session helpers: defaults, and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "edgeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the SQL settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings that hot keys need; safe to apply to a foreign session.

    A join feeding an aggregation on the same key keeps its partitioning, and
    then AQE leaves a skewed side alone unless it may add the extra exchange.
    """
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # Wide rows of counts and masks compress well: a small shuffle partition may
    # still be much work, so do not merge partitions below the core count early.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Rounds and epochs end in a written table: their shuffle files go with the query, not with a garbage collection.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-edgeloom-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes the tables that ``pin`` writes inside it, in this thread; one taken off the list stays."""
    token = _written.set(tables := [])
    try:
        yield tables
    finally:
        _written.reset(token)
        for table in tables:
            unpin(table)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back: no lineage left.

    Iterative operators call this once per round, and plans call it for inputs
    they scan several times.  A written table survives lost executors, keeps
    column pruning for its readers, and carries true size statistics.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pinned_path = path
    if (written := _written.get()) is not None:
        written.append(out)
    return out


def unpin(df: DataFrame) -> None:
    """Delete a table that ``pin`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._pinned_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
