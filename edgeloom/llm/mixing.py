"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

A document of source s is wanted ``e = target / source size`` times. Laid end to
end, the documents of a source cover ``[0, n·e)``; with one random offset, a
document is emitted once for every integer its stretch crosses, so no copy
count is off by more than one from its expectation, and neither is any run of
neighbours. Neighbours are documents of like size, which brings the words taken
close to the target too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.functions.keys import ordered_positions, text_hash
from edgeloom.llm.common import WORD, query, read, settle

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``(_source, source_size, target)`` from one row ``(_source, source_size)`` per source.

    Sources in code-point order, null last, take the weights in turn. Sharing by
    weight and sharing out the excess again until nobody is above ``cap`` times
    their size ends at ``min(cap · size, level · weight)``; in the order of
    ``cap · size / weight`` the capped sources come first, so running sums find
    the level. The windows hold one row a source, not one a document.
    """
    weighted = sizes.withColumn(
        "_w",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]),
            (F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1) % len(weights) + 1,
        ),
    )
    order = Window.orderBy(F.col("source_size") * cap / F.col("_w"), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighted.select(
        "*",
        (
            (F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
            .cast("double")
            / F.sum("_w").over(rest)
        ).alias("_level"),
    ).withColumn("_capped", F.col("source_size") * cap / F.col("_w") < F.col("_level"))
    return levels.select(
        "_source",
        "source_size",
        F.when(F.col("_capped"), (F.col("source_size") * cap).cast("double"))
        .otherwise(
            F.coalesce(F.first(F.when(~F.col("_capped"), F.col("_level")), ignorenulls=True).over(whole), F.lit(0.0))
            * F.col("_w")
        )
        .alias("target"),
    )


def size_class(size: Column) -> Column:
    """Eight classes an octave as text that sorts like the size."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 3, "0"), F.rpad(F.substring(bits, 1, 4), 4, "0"))


def mix(
    docs: DataFrame,
    size: Column,
    tie: Column,
    source: str = "source",
    doc_id: str = "doc_id",
    weights: Sequence[float] = WEIGHTS,
    cap: float = CAP,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with ``_size, _source_size, _target, _copies``; ``tie`` orders rows of one id.

    Null texts have size 0; a source whose size is 0 gets no target and no
    copies; a null source is a source of its own, last in order. Equal rows keep
    their own places, so one of two equal rows may be taken once more than the
    other. The same rows give the same copies on every run: order and offset
    come from md5 of the seed. A hot source is ordered in up to 37,000 slices
    (size class × two hash digits), never in one task.
    """
    sized = docs.withColumns(
        {
            "_size": size,
            "_key": F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")),
            "_h": text_hash(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))),
            "_t": tie,
        }
    ).withColumn("_class", size_class(F.col("_size")))
    sizes = sized.groupBy("_key").agg(F.sum("_size").alias("source_size"))
    targets = source_targets(
        sizes.select(F.when(F.col("_key") != "n", F.expr("substring(_key, 2)")).alias("_source"), "source_size"),
        weights,
        cap,
    ).select(
        F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n")).alias("_key"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
    )
    placed = ordered_positions(
        sized,
        ["_key"],
        ["_class", "_h", F.col(doc_id), "_size", "_t"],
        F.concat(F.col("_class"), F.substring("_h", 1, 2)),
        "_pos",
    ).join(targets, "_key")
    offset = (
        F.conv(F.substring(text_hash(F.lit(seed), F.lit("offset"), F.col("_key")), 1, 5), 16, 10).cast("double") + 0.5
    ) / (1 << 20)
    each = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    upto = lambda n: F.floor(n * each + offset)
    copies = F.least(upto(F.col("_pos")) - upto(F.col("_pos") - 1), F.lit(int(cap)))
    return placed.withColumn("_copies", copies.cast("long")).drop("_key", "_h", "_t", "_class", "_pos")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
l AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(source_size * {CAP}) OVER (ORDER BY source_size * {CAP} / w, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(w) OVER (ORDER BY source_size * {CAP} / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lev FROM w),
t AS (SELECT source, source_size, CASE WHEN source_size * {CAP} / w < lev THEN (source_size * {CAP})::DOUBLE
      ELSE coalesce((SELECT max_by(lev, -source_size * {CAP} / w) FROM l x WHERE NOT x.source_size * {CAP} / x.w < x.lev), 0.0) * w END AS target FROM l),
p AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY
        lpad(length(bin(size))::VARCHAR, 3, '0') || rpad(substr(bin(size), 1, 4), 4, '0'), h, doc_id, size) AS pos FROM d),
e AS (SELECT p.doc_id, p.size, p.pos, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
        (('0x' || substr(md5('{SEED}|offset|' || coalesce('s' || p.source, 'n')), 1, 5))::BIGINT + 0.5) / 1048576 AS o
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * least(floor(pos * each + o) - floor((pos - 1) * each + o), {CAP}))::BIGINT AS taken FROM e
"""


@query("op8_systematic_mix", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at weights 5, 2, 1 and at most threefold repetition."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("n"), F.xxhash64("text").alias("t"))
    mixed = mix(narrow, F.col("n"), F.col("t"))
    return mixed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, with its own columns, whatever their names."""
    settle(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    wrapped = docs.select(row).select("row", "row.doc_id", "row.source", word_count(F.col("row.text")).alias("n"), F.xxhash64("row.text").alias("t"))
    mixed = mix(wrapped, F.col("n"), F.col("t")).filter("_copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("copy")).select("row.*")
