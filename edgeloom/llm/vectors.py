"""Vector rows that searches can use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Every fiftieth row by id is a query of the registered searches.
QUERY_STEP = 50


def usable(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", zero_ok: bool = True) -> DataFrame:
    """``(vec_id long, v)`` of the vectors that take part.

    Left out: rows with a null id, null or empty vectors, vectors that hold a
    null or a value that is not finite, vectors of another length than most
    (ties: the longer), and, unless ``zero_ok``, zero vectors. Rows that repeat
    an id are one vector, the smallest in array order.
    """
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~odd
    )
    if not zero_ok:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows


def of_one_length(kept: DataFrame) -> DataFrame:
    """The rows of a kept table whose vectors have the commonest length."""
    sizes = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.filter(F.size("v") == (sizes["n"] if sizes else 0))
