"""Tables over experiments, runs and seeds."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.statistics import ci95_columns


def seed_group_name(name: Column) -> Column:
    """The run name without its trailing ``seed_<n>`` part."""
    stripped = F.regexp_extract(name, r"^(.*)/seed_\d+$", 1)
    return F.when(stripped != "", stripped).otherwise(name)


def unpivot_metrics(table: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return table.unpivot(list(ids), list(metrics), "metric", "value")


def seed_mean_std(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, sample std (0 for one seed) and seed count per domain and metric."""
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.count_distinct("seed").alias("n_seeds"),
    )


def seed_shape_violations(long: DataFrame, key: str = "domain") -> DataFrame:
    """(domain, metric) cells that some seed lacks."""
    seeds = long.agg(F.count_distinct("seed").alias("_all"))
    cells = long.groupBy(key, "metric").agg(F.count_distinct("seed").alias("n_seeds"))
    return cells.join(seeds, F.col("n_seeds") < F.col("_all")).select(
        key, "metric", "n_seeds", F.col("_all").alias("expected")
    )


def clamped_half_width(mean: str, half: str, low: float = -1.0, high: float = 1.0) -> Column:
    """A CI half-width that keeps mean ± half inside the metric's bounds."""
    room = F.greatest(F.least(F.lit(high) - F.col(mean), F.col(mean) - F.lit(low)), F.lit(0.0))
    return F.least(F.col(half), room)


def seed_aggregates(experiments: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per seed group: count, success rate and mean/std/CI of each metric."""
    rows = experiments.withColumn("group", seed_group_name(F.col("name")))
    aggs: list[Column] = [
        F.count("*").alias("n_seeds"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
    ]
    for m in metrics:
        aggs += [c.alias(f"{m}_{part}") for c, part in zip(ci95_columns(m), ("n", "mean", "std", "ci95"))]
    out = rows.groupBy("group").agg(*aggs)
    for m in metrics:
        out = out.withColumn(f"{m}_ci95", clamped_half_width(f"{m}_mean", f"{m}_ci95"))
    return out


def comparison_table(experiments: DataFrame, sides: Sequence[DataFrame], on: str = "name") -> DataFrame:
    """One wide row per experiment: its summary with every optional side table."""
    out = experiments
    for side in sides:
        out = out.join(side, on, "left")
    return out


def factor_decomposition(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Generations, best gain and archive size per configuration and domain."""
    return log.groupBy(*keys).agg(
        F.count_distinct("generation").alias("generations"),
        F.coalesce(F.max("gain"), F.lit(0.0)).alias("best_gain"),
        F.max("archive_size").alias("archive_size"),
    )


def matrix_summary(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total, completed, successful and failed runs with CIs of score and duration."""
    done = F.col("status").isin("completed", "failed")
    aggs = [
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if((F.col("status") == "completed") & F.col("success")).alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(~done).alias("open"),
    ]
    for m in ("score", "duration"):
        aggs += [c.alias(f"{m}_{part}") for c, part in zip(ci95_columns(m), ("n", "mean", "std", "ci95"))]
    return runs.groupBy(*keys).agg(*aggs)


def benchmark_summary(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n_runs"),
        F.count_if("success").alias("success_count"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
    )


def reeval_success(runs: DataFrame, keys: Sequence[str], threshold: float = 0.85) -> DataFrame:
    """Recount with success := score ≥ threshold; the criterion stays in the row."""
    judged = runs.withColumn("success", F.coalesce(F.col("score") >= threshold, F.lit(False)))
    return benchmark_summary(judged, keys).withColumn("criterion", F.lit(float(threshold)))


def runtime_stats(lines: DataFrame, keys: Sequence[str], text: str = "value") -> DataFrame:
    """``real <seconds>`` lines → count, mean and population std."""
    sec = F.regexp_extract(text, r"^\s*real\s+([0-9]+(?:\.[0-9]+)?)\s*$", 1)
    rows = lines.withColumn("_sec", F.when(sec != "", sec.cast("double"))).filter("_sec IS NOT NULL")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_sec").alias("mean"), F.stddev_pop("_sec").alias("std")
    )


def failure_modes(proposals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histogram over kind, edge type and effect of valid proposals on the hit rate."""
    effect = (
        F.when(~F.col("valid"), "invalid")
        .when(F.col("hits_delta") > 0, "helpful")
        .when(F.col("hits_delta") < 0, "harmful")
        .otherwise("neutral")
    )
    return proposals.groupBy(*keys, "proposal_type", "edge_type", effect.alias("effect")).agg(
        F.count("*").alias("n")
    )


def regime_points(rows: DataFrame, ids: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """Long (regime, x, y) points of several graph properties against one gap."""
    return rows.select(*ids, *xs, y).unpivot([*ids, y], list(xs), "regime", "x")


def success_criteria(
    runs: DataFrame, threshold: float = 0.85, parity: float = 0.0, satisfaction: float = 0.95
) -> DataFrame:
    """Success flags: correlation runs need threshold, healthy baselines and parity;
    bound runs need score and satisfaction."""
    reaches = F.coalesce(F.col("score") >= threshold, F.lit(False))
    healthy = F.coalesce(F.col("baseline_status") == "ok", F.lit(False))
    level = F.coalesce(F.col("score") + parity >= F.col("baseline_score"), F.lit(False))
    bound = F.col("fitness_mode") != "correlation"
    satisfied = F.coalesce(F.col("satisfaction_rate") >= satisfaction, F.lit(False))
    return runs.select(
        "*",
        reaches.alias("meets_threshold"),
        healthy.alias("baselines_healthy"),
        level.alias("baseline_parity"),
        F.when(bound, reaches & satisfied).otherwise(reaches & healthy & level).alias("success"),
    )


def fingerprint(values: DataFrame, keys: Sequence[str], position: str, value: str, levels: int = 3) -> DataFrame:
    """sha256 over the ordered values of each split, as a tree of digests.

    Stretches of 1024 positions are hashed, then stretches of 1024 digests, and
    so on for ``levels`` levels; the digests left are hashed in order.  No array
    is longer than 1024 while positions stay below ``1024 ** (levels + 1)``.
    The depth is part of the definition and does not follow the data.  Positions
    are distinct within a split; a null value hashes like its position alone.
    """
    keys = list(keys)
    text = F.concat_ws(":", F.col(position).cast("string"), F.col(value).cast("string"))
    level = values.select(
        *keys, F.col(position).cast("long").alias("_at"), text.alias("_h"), F.lit(1).cast("long").alias("n")
    )

    def digest() -> Column:
        ordered = F.sort_array(F.collect_list(F.struct("_at", "_h")))
        return F.sha2(F.array_join(F.transform(ordered, lambda s: s["_h"]), ","), 256)

    for _ in range(levels):
        above = F.floor(F.col("_at") / 1024).cast("long").alias("_above")
        level = (
            level.groupBy(*keys, above).agg(digest().alias("_h"), F.sum("n").alias("n")).withColumnRenamed("_above", "_at")
        )
    return level.groupBy(*keys).agg(digest().alias("fingerprint"), F.sum("n").alias("n"))


def dataset_fingerprint(splits: DataFrame, keys: Sequence[str], split: str, config: Mapping[str, object]) -> DataFrame:
    """One sha256 per dataset over its configuration, as sorted JSON, and the sizes and fingerprints of its splits."""
    head = json.dumps(dict(config), sort_keys=True, ensure_ascii=False)
    line = F.concat_ws(":", F.col(split).cast("string"), F.col("n").cast("string"), F.col("fingerprint"))
    return splits.groupBy(*keys).agg(
        F.sha2(F.concat(F.lit(head + "|"), F.array_join(F.array_sort(F.collect_list(line)), ",")), 256).alias("dataset"),
        F.count("*").alias("n_splits"),
        F.sum("n").alias("n"),
    )


def appendix_counts(runs: DataFrame, keys: Sequence[str], expected_seeds: Sequence[int], small: int = 5) -> DataFrame:
    """Completion, runtime CI, missing seeds and failure counts per group."""
    keys = list(keys)
    wanted = F.array(*[F.lit(int(s)) for s in expected_seeds])
    have = F.collect_set(F.when(F.col("status") == "completed", F.col("seed").cast("int")))
    aggs = [
        F.count("*").alias("n_runs"),
        F.count_if(F.col("status") == "completed").alias("n_completed"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.concat_ws(", ", F.array_sort(F.array_except(wanted, have)).cast("array<string>")).alias("missing_seeds"),
        F.sum(F.col("generations") * F.col("islands") * F.col("population") + F.col("repairs")).alias("call_budget"),
    ]
    aggs += [c.alias(f"runtime_{part}") for c, part in zip(ci95_columns("duration"), ("n", "mean", "std", "ci95"))]
    return runs.groupBy(*keys).agg(*aggs).withColumn("small_data", F.col("n_completed") < small)


def rubric_summary(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean score per rubric dimension."""
    return long.groupBy(*keys, "dimension").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))


def rubric_violations(long: DataFrame, low: int = 1, high: int = 5) -> DataFrame:
    return long.filter(F.col("score").isNull() | ~F.col("score").between(low, high))


def judge_agreement(a: DataFrame, b: DataFrame, ids: Sequence[str], keys: Sequence[str], tolerance: float = 1.0) -> DataFrame:
    """Share of dimensions on which two judges differ by at most ``tolerance``."""
    both = a.withColumnRenamed("score", "_a").join(b.withColumnRenamed("score", "_b"), list(ids))
    return both.groupBy(*keys).agg(
        F.avg((F.abs(F.col("_a") - F.col("_b")) <= tolerance).cast("double")).alias("agreement"),
        F.count("*").alias("n"),
    )


def model_vs_baseline(scores: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Paired scores of a model and its baseline by (domain, seed)."""
    return scores.join(baseline, list(keys)).withColumn("diff", F.col("a") - F.col("b"))
