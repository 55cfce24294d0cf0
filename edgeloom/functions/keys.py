"""Hash order and two-level running aggregates.

A window over a grouping key puts the whole group into one task.  When a group
may hold a large part of the table, the helpers here split it by a *bucket*
that grows with the sort order: aggregate per bucket, run the window over the
few bucket rows, and finish inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_hash(*parts: Column | str | int) -> Column:
    """md5 hex over ``|``-joined parts: a uniform order every engine agrees on."""
    cols = [
        F.col(p) if isinstance(p, str) else (p if isinstance(p, Column) else F.lit(str(p)))
        for p in parts
    ]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash_int(hexcol: Column | str, digits: int = 15) -> Column:
    """The leading hex digits of a hash as a non-negative integer, 60 bits by default."""
    col = F.col(hexcol) if isinstance(hexcol, str) else hexcol
    return F.conv(F.substring(col, 1, digits), 16, 10).cast("long")


def hash_bucket(hexcol: Column | str, digits: int = 3) -> Column:
    """A prefix of the hash: evenly filled, and monotone in hash order."""
    col = F.col(hexcol) if isinstance(hexcol, str) else hexcol
    return F.substring(col, 1, digits)


def quantile_bucket(df: DataFrame, col: str, n: int = 64) -> Column:
    """A monotone bucket of a numeric column, balanced over ``df``.

    One aggregate fetches at most ``n`` bounds; the lookup is a balanced tree
    of comparisons and stays inside generated code.
    """
    probs = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, 10 * n).alias("b")).first()
    bounds = sorted(set(row["b"] or []))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(col) <= bounds[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def ordered_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    name: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Exact ``row_number()`` per ``keys``; no task ever holds a whole group.

    ``total`` names a column for the group size, which the bucket rows know.
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    extra = [F.sum("_n").over(whole).alias(total)] if total else []
    offsets = sizes.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), *extra
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        tagged.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.row_number().over(inside) + F.col("_offset"))
        .drop("_bucket", "_offset")
    )


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    value: Column,
    name: str,
    inclusive: bool = False,
) -> DataFrame:
    """Maximum of ``value`` over the rows before (or up to) this one, per ``keys``.

    With a struct that starts with the sort key this is also ``lag``.
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket).withColumn("_v", value)
    tops = tagged.groupBy(*keys, "_bucket").agg(F.max("_v").alias("_top"))
    over_buckets = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = tops.select(*keys, "_bucket", F.max("_top").over(over_buckets).alias("_carry"))
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    return (
        tagged.join(carried, [*keys, "_bucket"])
        .withColumn(name, F.greatest(F.max("_v").over(inside), F.col("_carry")))
        .drop("_bucket", "_v", "_carry")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` in the given order."""
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket).withColumn("_v", value)
    tops = tagged.groupBy(*keys, "_bucket").agg(F.sum("_v").alias("_top"))
    over_buckets = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = tops.select(
        *keys, "_bucket", F.coalesce(F.sum("_top").over(over_buckets), F.lit(0)).alias("_carry")
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        tagged.join(carried, [*keys, "_bucket"])
        .withColumn(name, F.sum("_v").over(inside) + F.col("_carry"))
        .drop("_bucket", "_v", "_carry")
    )


def expand_copies(df: DataFrame, count_col: str, copy_col: str, chunk: int = 65536) -> DataFrame:
    """Rows repeated ``count_col`` times and numbered from 1.

    Only a heavily repeated row costs a shuffle: it is cut into chunks that are
    spread over the cluster before they are expanded.
    """
    others = [c for c in df.columns if c != count_col]
    few = df.filter(F.col(count_col) <= chunk).select(
        *others, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count_col))).alias(copy_col)
    )
    last_chunk = F.floor((F.col(count_col) - 1) / chunk).cast("long")
    chunks = df.filter(F.col(count_col) > chunk).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk))
    )
    first = F.col("_chunk") * chunk + 1
    last = F.least(F.col(count_col).cast("long"), (F.col("_chunk") + 1) * chunk)
    many = chunks.repartition(*others, "_chunk").select(
        *others, F.explode(F.sequence(first, last)).alias(copy_col)
    )
    return few.unionByName(many)
