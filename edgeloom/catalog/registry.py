"""Name → query and name → SQL tables filled by the ``query`` decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from edgeloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def rounded(columns: str, sql: str, digits: int = DIGITS) -> str:
    """The SQL twin of ``finish``: the named double columns rounded."""
    parts = ", ".join(
        f"round({c}::DOUBLE, {digits}) + 0.0 AS {c}" for c in columns.replace(" ", "").split(",")
    )
    return f"SELECT * REPLACE ({parts}) FROM ({sql})"


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column, so that summation order does not show."""
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(field.dataType, (T.DecimalType,)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query (and its SQL, when SQL can express it)."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return finish(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


_READERS: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table; the reader is kept so its footers are listed once per session."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    if key not in _READERS:
        _READERS[key] = spark.read.parquet(key[1])
    return _READERS[key]
