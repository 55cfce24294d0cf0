"""Event logs and run logs: funnels, curves, state machines and pairings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.keys import running_max, running_sum

# A gain counts as an improvement above this margin.
IMPROVEMENT_MARGIN = 1e-12


def acceptance_funnel(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per generation: evaluated, rejected, attempted and the acceptance rate.

    ``events(keys…, generation, event_type)`` with candidate_evaluated and
    candidate_rejected rows; rows without a generation are ignored.
    """
    evaluated = F.count_if(F.col("event_type") == "candidate_evaluated")
    rejected = F.count_if(F.col("event_type") == "candidate_rejected")
    return (
        events.filter(F.col("generation").isNotNull())
        .groupBy(*keys, "generation")
        .agg(evaluated.alias("evaluated"), rejected.alias("rejected"))
        .withColumn("attempted", F.col("evaluated") + F.col("rejected"))
        .filter("attempted > 0")
        .withColumn("acceptance_rate", F.col("evaluated") / F.col("attempted"))
    )


def repair_breakdown(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repair attempts and their outcomes, from repair events and their status."""
    result = F.col("event_type") == "candidate_repair_result"
    return events.groupBy(*keys).agg(
        F.count_if(F.col("event_type") == "candidate_repair_attempted").alias("repair_attempts"),
        F.count_if(result & (F.col("status") == "success")).alias("repair_successes"),
        F.count_if(result & (F.col("status") == "failed")).alias("repair_failures"),
    )


def rejection_reasons(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        events.filter((F.col("event_type") == "candidate_rejected") & F.col("reason").isNotNull())
        .groupBy(*keys, "reason")
        .agg(F.count("*").alias("n"))
    )


def bounds_diagnostics(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range of gap and satisfaction over evaluated candidates."""
    seen = F.col("event_type") == "candidate_evaluated"
    gap, rate = F.when(seen, F.col("mean_gap")), F.when(seen, F.col("satisfaction_rate"))
    return events.groupBy(*keys).agg(
        F.min(gap).alias("min_gap"),
        F.max(gap).alias("max_gap"),
        F.min(rate).alias("min_satisfaction"),
        F.max(rate).alias("max_satisfaction"),
    )


def convergence_curve(events: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per generation from its summary event; the latest summary wins."""
    latest = F.max_by(F.struct(*values), F.struct("pos"))
    return (
        events.filter((F.col("event_type") == "generation_summary") & F.col("generation").isNotNull())
        .groupBy(*keys, "generation")
        .agg(latest.alias("_v"))
        .select(*keys, "generation", *[F.col(f"_v.{v}").alias(v) for v in values])
    )


def no_improve_counter(
    curve: DataFrame, keys: Sequence[str], bucket: Column, patience: int, start: float = 0.0
) -> DataFrame:
    """Running best, generations since it last improved, and the early-stop flag.

    ``curve(keys…, generation, best)``; ``bucket`` grows with the generation.
    """
    keys = list(keys)
    seen = running_max(curve, keys, ["generation"], bucket, F.col("best"), "_before")
    before = F.greatest(F.coalesce("_before", F.lit(start)), F.lit(start))
    flagged = seen.withColumn(
        "improved", F.col("best") > before + IMPROVEMENT_MARGIN
    ).withColumn("best_so_far", F.greatest(before, F.col("best")))
    counted = running_sum(
        flagged, keys, ["generation"], bucket, F.lit(1).cast("long"), "_turn"
    )
    last = running_max(
        counted, keys, ["generation"], bucket,
        F.when(F.col("improved"), F.col("_turn")), "_last", inclusive=True,
    )
    since = F.col("_turn") - F.coalesce("_last", F.lit(0))
    return (
        last.withColumn("no_improve", since)
        .withColumn("stop", since >= patience)
        .drop("_before", "_turn", "_last")
    )


# Invalid generations in a row before the prompt is constrained,
# and constrained generations before it recovers.
TRIGGER = 5
RECOVERY = 3


def stagnation_mode(
    turns: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    rule: str = "reset",
    trigger: int = TRIGGER,
    recovery: int = RECOVERY,
    fallback: bool = True,
    late_recovery: bool = False,
) -> DataFrame:
    """Prompt mode after every generation of ``turns(keys…, generation, valid)``.

    Adds ``streak``, ``mode`` and ``span``, the invalid generations counted as
    constrained.  All follow from the invalid streak, so a log of any length
    needs running aggregates and no replay.  A null ``valid`` is invalid.

    ``reset``: a streak starts over after ``trigger + recovery − 1`` invalid
    generations, and the ``trigger``-th already counts as constrained.
    ``lock``: the generation after it is the first that counts, and a valid one
    frees the island unless its span outlived ``recovery``; with
    ``late_recovery`` it always does, without ``fallback`` nothing is ever
    counted or constrained.  The two switches belong to ``lock``.
    """
    if rule not in ("reset", "lock"):
        raise ValueError("rule must be 'reset' or 'lock'")
    if rule == "reset" and (late_recovery or not fallback):
        raise ValueError("fallback and late_recovery belong to the rule 'lock'")
    keys = list(keys)
    zero = F.lit(0).cast("long")
    if not fallback:
        return turns.withColumn("streak", zero).withColumn("mode", F.lit("free")).withColumn("span", zero)
    trigger = max(trigger, 1)
    counted = running_sum(turns, keys, ["generation"], bucket, F.lit(1).cast("long"), "_turn")
    last = running_max(
        counted, keys, ["generation"], bucket, F.when(F.col("valid"), F.col("_turn")), "_valid",
        inclusive=True,
    )
    out = last.withColumn("streak", F.col("_turn") - F.coalesce("_valid", zero))
    streak = F.col("streak")
    locked = F.lit(False)
    if rule == "reset":
        out = out.withColumn("streak", streak % (trigger + max(recovery, 1) - 1))
        span = F.greatest(streak - trigger + 1, zero)
    else:
        span = F.greatest(streak - trigger, zero)
    if rule == "lock" and not late_recovery:
        # The first streak to outlive the recovery locks; from then on every invalid generation counts.
        outlived = trigger + max(recovery, -1) + 1
        invalid = F.when(F.col("valid"), 0).otherwise(1).cast("long")
        out = running_sum(out, keys, ["generation"], bucket, invalid, "_invalid")
        out = running_max(
            out, keys, ["generation"], bucket, F.when(streak == outlived, -F.col("_invalid")), "_lock", inclusive=True
        )
        locked = F.col("_lock").isNotNull()
        span = F.when(locked, F.col("_invalid") + F.col("_lock") + outlived - trigger).otherwise(span)
    mode = F.when((streak >= trigger) | locked, "constrained").otherwise("free")
    return out.withColumn("mode", mode).withColumn("span", span).drop("_turn", "_valid", "_invalid", "_lock")


RUN_LINE = r"^\[(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})[^\]]*\]\s+(RUN|DONE|FAIL)\s+domain=(\S+)\s+seed=(\d+)"


def parse_run_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Timestamp, action, domain and seed of every matching run-log line."""
    def part(i: int) -> Column:
        return F.regexp_extract(text, RUN_LINE, i)

    return lines.filter(F.col(text).rlike(RUN_LINE)).select(
        *[c for c in lines.columns if c != text],
        F.to_timestamp(F.replace(part(1), F.lit("T"), F.lit(" "))).alias("ts"),
        part(2).alias("action"), part(3).alias("domain"), part(4).cast("int").alias("seed"),
    )


def run_pairing(runs: DataFrame, keys: Sequence[str], bucket: Column, line: str = "line_no") -> DataFrame:
    """Every DONE/FAIL with the RUN just before it; without one the duration is null."""
    keys = list(keys)
    seen = running_max(
        runs, keys, [line], bucket, F.struct(F.col(line), F.col("action"), F.col("ts")), "_prev"
    )
    opened = F.col("_prev.action") == "RUN"
    seconds = F.unix_micros("ts") - F.unix_micros("_prev.ts")
    return seen.filter(F.col("action").isin("DONE", "FAIL")).select(
        *keys, line, F.col("action").alias("status"),
        F.when(opened, seconds / 1e6).alias("duration_sec"),
    )
