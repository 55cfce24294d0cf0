"""Run logs from events, and experiment tables from orders."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import functions as F

from edgeloom.catalog.registry import query, rounded, table
from edgeloom.functions.numeric import finite, parsed_float, safe_float, status_code
from edgeloom.operators import experiments as X
from edgeloom.operators import logs as L
from edgeloom.operators.statistics import T_975

LOG_SQL = """log AS (SELECT event_id AS pos, (user_id % 5)::INTEGER AS island, day(ts)::INTEGER AS generation,
  CASE event_type WHEN 'purchase' THEN 'candidate_evaluated' WHEN 'error' THEN 'candidate_rejected' WHEN 'click' THEN 'candidate_repair_attempted'
    WHEN 'signup' THEN 'candidate_repair_result' ELSE 'generation_summary' END AS event_type,
  CASE WHEN event_type = 'signup' THEN CASE WHEN value > 10 THEN 'success' ELSE 'failed' END END AS status,
  CASE WHEN event_type = 'error' THEN 'k' || (props->>'$.k') END AS reason, value AS mean_gap, value / 100 AS satisfaction_rate, value AS best_score FROM events)"""


def event_log(spark, d):
    """Events as a search log: generation = day, island = user group."""
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").alias("pos"),
        (F.col("user_id") % 5).cast("int").alias("island"),
        F.dayofmonth("ts").alias("generation"),
        F.when(kind == "purchase", "candidate_evaluated").when(kind == "error", "candidate_rejected")
        .when(kind == "click", "candidate_repair_attempted").when(kind == "signup", "candidate_repair_result")
        .otherwise("generation_summary").alias("event_type"),
        F.when(kind == "signup", F.when(F.col("value") > 10, "success").otherwise("failed")).alias("status"),
        F.when(kind == "error", F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("reason"),
        F.col("value").alias("mean_gap"),
        (F.col("value") / 100).alias("satisfaction_rate"),
        F.col("value").alias("best_score"),
    )


@query(
    "E15_acceptance_funnel",
    rounded(
        "acceptance_rate",
        f"""WITH {LOG_SQL} SELECT island, generation, evaluated, rejected, evaluated + rejected AS attempted, evaluated / (evaluated + rejected) AS acceptance_rate
            FROM (SELECT island, generation, count(*) FILTER (WHERE event_type = 'candidate_evaluated') AS evaluated,
              count(*) FILTER (WHERE event_type = 'candidate_rejected') AS rejected FROM log GROUP BY ALL) WHERE evaluated + rejected > 0""",
    ),
)
def funnel(spark, d):
    return L.acceptance_funnel(event_log(spark, d), ["island"])


@query(
    "E16_repair_breakdown",
    f"""WITH {LOG_SQL} SELECT island, count(*) FILTER (WHERE event_type = 'candidate_repair_attempted') AS repair_attempts,
        count(*) FILTER (WHERE status = 'success') AS repair_successes, count(*) FILTER (WHERE status = 'failed') AS repair_failures,
        (SELECT count(DISTINCT reason) FROM log r WHERE r.island = log.island) AS n_reasons FROM log GROUP BY island""",
)
def repairs(spark, d):
    log = event_log(spark, d)
    reasons = L.rejection_reasons(log, ["island"]).groupBy("island").agg(F.count("*").alias("n_reasons"))
    return L.repair_breakdown(log, ["island"]).join(reasons, "island", "left").fillna(0)


@query(
    "E17_bounds_diagnostics",
    rounded(
        "min_gap, max_gap, min_satisfaction, max_satisfaction",
        f"""WITH {LOG_SQL} SELECT island, min(mean_gap) AS min_gap, max(mean_gap) AS max_gap, min(satisfaction_rate) AS min_satisfaction,
            max(satisfaction_rate) AS max_satisfaction FROM log WHERE event_type = 'candidate_evaluated' GROUP BY island""",
    ),
)
def bounds(spark, d):
    return L.bounds_diagnostics(event_log(spark, d), ["island"])


@query(
    "E18_convergence_curve",
    rounded(
        "best_score",
        f"""WITH {LOG_SQL} SELECT island, generation, arg_max(best_score, pos) AS best_score FROM log
            WHERE event_type = 'generation_summary' GROUP BY ALL""",
    ),
)
def curve(spark, d):
    return L.convergence_curve(event_log(spark, d), ["island"], ["best_score"])


CURVE_SQL = """curve AS (SELECT user_id AS run, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS generation, max(value) AS best,
   bool_or(event_type = 'purchase') AS valid FROM events GROUP BY ALL)"""


def curves(spark, d):
    hour = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(1704067200)) / 3600)
    return table(spark, d, "events").groupBy(F.col("user_id").alias("run"), hour.alias("generation")).agg(
        F.max("value").alias("best"), F.bool_or(F.col("event_type") == "purchase").alias("valid")
    )


@query(
    "W3_no_improve_counter",
    rounded(
        "best_so_far",
        f"""WITH {CURVE_SQL}, b AS (SELECT *, greatest(0, coalesce(max(best) OVER (PARTITION BY run ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING
              AND 1 PRECEDING), 0)) AS before, row_number() OVER (PARTITION BY run ORDER BY generation) AS turn FROM curve),
            c AS (SELECT *, turn - coalesce(max(CASE WHEN best > before + 1e-12 THEN turn END) OVER (PARTITION BY run ORDER BY generation), 0) AS no_improve FROM b)
            SELECT run, generation, best > before + 1e-12 AS improved, greatest(before, best) AS best_so_far, no_improve, no_improve >= 20 AS stop FROM c""",
    ),
)
def no_improve(spark, d):
    out = L.no_improve_counter(curves(spark, d), ["run"], F.floor(F.col("generation") / 24), patience=20)
    return out.select("run", "generation", "improved", "best_so_far", "no_improve", "stop")


@query(
    "W4_stagnation_mode",
    f"""WITH {CURVE_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY generation) AS turn FROM curve),
        s AS (SELECT *, turn - coalesce(max(CASE WHEN valid THEN turn END) OVER (PARTITION BY run ORDER BY generation), 0) AS full_streak FROM t),
        m AS (SELECT *, max(full_streak) OVER (PARTITION BY run ORDER BY generation) AS longest FROM s)
        SELECT run, generation, full_streak % 7 AS streak, CASE WHEN full_streak % 7 >= 5 THEN 'constrained' ELSE 'free' END AS mode,
          CASE WHEN full_streak >= 5 OR longest > 8 THEN 'constrained' ELSE 'free' END AS lock_mode FROM m""",
)
def stagnation(spark, d):
    """Both recovery rules side by side."""
    turns = curves(spark, d)
    bucket = F.floor(F.col("generation") / 24)
    first = L.stagnation_mode(turns, ["run"], bucket)
    second = L.stagnation_mode(turns, ["run"], bucket, rule="lock").select(
        "run", "generation", F.col("mode").alias("lock_mode")
    )
    return first.select("run", "generation", "streak", "mode").join(second, ["run", "generation"])


@query(
    "W4_stagnation_switches",
    f"""WITH {CURVE_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY generation) AS turn FROM curve),
        s AS (SELECT *, turn - coalesce(max(CASE WHEN valid THEN turn END) OVER w, 0) AS streak,
          sum(CASE WHEN valid THEN 0 ELSE 1 END) OVER w AS invalid FROM t WINDOW w AS (PARTITION BY run ORDER BY generation)),
        m AS (SELECT *, min(CASE WHEN streak = 6 THEN invalid END) OVER (PARTITION BY run ORDER BY generation) AS since FROM s)
        SELECT run, generation, 'reset' AS rule, streak % 5 AS streak, CASE WHEN streak % 5 >= 2 THEN 'constrained' ELSE 'free' END AS mode,
          greatest(streak % 5 - 1, 0) AS span FROM m
        UNION ALL SELECT run, generation, 'lock', streak, CASE WHEN streak >= 2 OR since IS NOT NULL THEN 'constrained' ELSE 'free' END,
          (CASE WHEN since IS NOT NULL THEN invalid - since + 4 ELSE greatest(streak - 2, 0) END)::BIGINT FROM m
        UNION ALL SELECT run, generation, 'late', streak, CASE WHEN streak >= 2 THEN 'constrained' ELSE 'free' END, greatest(streak - 2, 0) FROM m
        UNION ALL SELECT run, generation, 'off', 0, 'free', 0 FROM m""",
)
def stagnation_switches(spark, d):
    """Every rule and switch at trigger 2: recovery 4 for the reset, 3 for the lock."""
    turns = curves(spark, d)
    bucket = F.floor(F.col("generation") / 24)
    rules = {
        "reset": {"rule": "reset", "recovery": 4},
        "lock": {"rule": "lock", "recovery": 3},
        "late": {"rule": "lock", "recovery": 3, "late_recovery": True},
        "off": {"rule": "lock", "recovery": 3, "fallback": False},
    }
    parts = [
        L.stagnation_mode(turns, ["run"], bucket, trigger=2, **switches).select(
            "run", "generation", F.lit(name).alias("rule"), "streak", "mode", "span"
        )
        for name, switches in rules.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


LINES_SQL = """lines AS (SELECT event_id AS line_no, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO] ' || CASE event_type WHEN 'click' THEN 'RUN'
   WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAIL' ELSE 'NOTE' END || ' domain=user' || user_id || ' seed=' || user_id % 3 AS value FROM events),
runs AS (SELECT line_no, date_trunc('second', ts) AS ts, CASE event_type WHEN 'click' THEN 'RUN' WHEN 'purchase' THEN 'DONE' ELSE 'FAIL' END AS action,
   'user' || user_id AS domain, (user_id % 3)::INTEGER AS seed FROM lines JOIN events ON line_no = event_id WHERE event_type IN ('click', 'purchase', 'error')),
paired AS (SELECT domain, seed, line_no, action AS status, CASE WHEN lag(action) OVER w = 'RUN'
   THEN date_diff('second', lag(ts) OVER w, ts)::DOUBLE END AS duration_sec, action FROM runs WINDOW w AS (PARTITION BY domain, seed ORDER BY line_no))"""


def run_lines(spark, d):
    kind = F.col("event_type")
    action = (
        F.when(kind == "click", "RUN").when(kind == "purchase", "DONE").when(kind == "error", "FAIL").otherwise("NOTE")
    )
    return table(spark, d, "events").select(
        F.col("event_id").alias("line_no"),
        F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO] "), action,
                 F.lit(" domain=user"), F.col("user_id"), F.lit(" seed="), F.col("user_id") % 3).alias("value"),
    )


@query(
    "J7_run_pairing",
    rounded("duration_sec", f"WITH {LINES_SQL} SELECT domain, seed, line_no, status, duration_sec FROM paired WHERE action <> 'RUN'"),
)
def pairing(spark, d):
    runs = L.parse_run_lines(run_lines(spark, d))
    return L.run_pairing(runs, ["domain", "seed"], F.floor(F.col("line_no") / 4096))


@query(
    "W5_previous_event",
    f"""WITH {LINES_SQL} SELECT domain, seed, line_no, lag(action) OVER (PARTITION BY domain, seed ORDER BY line_no) AS previous FROM runs""",
)
def previous(spark, d):
    from edgeloom.functions.keys import running_max

    runs = L.parse_run_lines(run_lines(spark, d))
    seen = running_max(runs, ["domain", "seed"], ["line_no"], F.floor(F.col("line_no") / 4096),
                       F.struct("line_no", "action"), "_p")
    return seen.select("domain", "seed", "line_no", F.col("_p.action").alias("previous"))


# ---------------------------------------------------------- experiment tables

METRIC_SQL = """mt AS (SELECT o_orderpriority AS domain, month(o_orderdate)::INTEGER AS seed, avg(o_totalprice) / 1e6 AS price, count(*) / 1e4 AS volume,
   max(o_totalprice) / 1e6 AS top, stddev_pop(o_totalprice) / 1e6 AS spread FROM orders GROUP BY ALL),
long AS (SELECT domain, seed, 'price' AS metric, price AS value FROM mt UNION ALL SELECT domain, seed, 'volume', volume FROM mt
   UNION ALL SELECT domain, seed, 'top', top FROM mt UNION ALL SELECT domain, seed, 'spread', spread FROM mt)"""
METRICS = ["price", "volume", "top", "spread"]


def metric_table(spark, d):
    """One row of metrics per (priority, month): the multi-seed result table."""
    return table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("domain"), F.month("o_orderdate").alias("seed")
    ).agg(
        (F.avg("o_totalprice") / 1e6).alias("price"), (F.count("*") / 1e4).alias("volume"),
        (F.max("o_totalprice") / 1e6).alias("top"), (F.stddev_pop("o_totalprice") / 1e6).alias("spread"),
    )


def metric_long(spark, d):
    return X.unpivot_metrics(metric_table(spark, d), ["domain", "seed"], METRICS)


def ci_sql(value: str, prefix: str = "") -> str:
    t = "[" + ", ".join(str(x) for x in T_975) + "]"
    return (
        f"count({value}) AS {prefix}n, avg({value}) AS {prefix}mean, CASE WHEN count({value}) > 1 THEN stddev_samp({value}) WHEN count({value}) = 1 THEN 0 END AS {prefix}std, "
        f"CASE WHEN count({value}) > 1 THEN coalesce({t}[count({value}) - 1], 1.96)::DOUBLE * stddev_samp({value}) / sqrt(count({value})) WHEN count({value}) = 1 THEN 0 END AS {prefix}ci95"
    )


@query(
    "E11_seed_mean_std",
    rounded(
        "mean, std",
        f"WITH {METRIC_SQL} SELECT domain, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(DISTINCT seed) AS n_seeds FROM long GROUP BY ALL",
    ),
)
def mean_std(spark, d):
    return X.seed_mean_std(metric_long(spark, d), ["domain"])


@query(
    "E12_seed_shape_check",
    """WITH long AS (SELECT c_mktsegment AS domain, c_nationkey AS metric, month(o_orderdate) * 100 + day(o_orderdate) AS seed FROM orders JOIN customer ON o_custkey = c_custkey)
       SELECT domain, metric, count(DISTINCT seed) AS n_seeds, (SELECT count(DISTINCT seed) FROM long) AS expected FROM long GROUP BY ALL
       HAVING count(DISTINCT seed) < (SELECT count(DISTINCT seed) FROM long)""",
)
def shape(spark, d):
    long = (
        table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("c_mktsegment").alias("domain"), F.col("c_nationkey").alias("metric"),
                (F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate")).alias("seed"))
    )
    return X.seed_shape_violations(long)


RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, 'exp_' || o_custkey % 40 || CASE WHEN o_custkey % 40 < 30 THEN '/seed_' || o_orderkey % 20 ELSE '' END AS name,
  o_orderpriority AS grp, (o_orderkey % 20)::INTEGER AS seed, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
  o_totalprice / 500000 AS score, o_totalprice > 250000 AS success, CASE WHEN o_orderstatus = 'F' THEN (o_custkey % 600) / 10.0::DOUBLE END AS duration,
  (o_orderkey % 30)::BIGINT AS generations, (o_custkey % 4)::BIGINT AS islands, 5::BIGINT AS population, (o_custkey % 11)::BIGINT AS repairs,
  CASE WHEN o_custkey % 9 = 0 THEN 'error' ELSE 'ok' END AS baseline_status, (o_custkey % 100) / 100.0::DOUBLE AS baseline_score,
  CASE WHEN o_custkey % 3 = 0 THEN 'upper_bound' ELSE 'correlation' END AS fitness_mode, (o_custkey % 50) / 50.0::DOUBLE AS satisfaction_rate FROM orders)"""


def runs(spark, d):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, d, "orders").select(
        o.alias("run_id"),
        F.concat(F.lit("exp_"), c % 40, F.when(c % 40 < 30, F.concat(F.lit("/seed_"), o % 20)).otherwise(F.lit(""))).alias("name"),
        F.col("o_orderpriority").alias("grp"),
        (o % 20).cast("int").alias("seed"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running").alias("status"),
        (F.col("o_totalprice") / 500000).alias("score"),
        (F.col("o_totalprice") > 250000).alias("success"),
        F.when(F.col("o_orderstatus") == "F", (c % 600) / 10.0).alias("duration"),
        (o % 30).alias("generations"), (c % 4).alias("islands"), F.lit(5).cast("long").alias("population"),
        (c % 11).alias("repairs"),
        F.when(c % 9 == 0, "error").otherwise("ok").alias("baseline_status"),
        ((c % 100) / 100.0).alias("baseline_score"),
        F.when(c % 3 == 0, "upper_bound").otherwise("correlation").alias("fitness_mode"),
        ((c % 50) / 50.0).alias("satisfaction_rate"),
    )


@query(
    "P12_seed_group_name",
    f"WITH {RUNS_SQL} SELECT run_id, regexp_replace(name, '/seed_[0-9]+$', '') AS grp FROM runs",
)
def group_name(spark, d):
    return runs(spark, d).select("run_id", X.seed_group_name(F.col("name")).alias("grp"))


@query(
    "E13_seed_aggregates",
    rounded(
        "success_rate, score_mean, score_std, score_ci95, duration_mean, duration_std, duration_ci95",
        f"""WITH {RUNS_SQL}, a AS (SELECT regexp_replace(name, '/seed_[0-9]+$', '') AS "group", count(*) AS n_seeds, avg(success::INTEGER) AS success_rate,
            {ci_sql('score', 'score_')}, {ci_sql('duration', 'duration_')} FROM runs GROUP BY 1)
            SELECT * REPLACE (least(score_ci95, greatest(0, least(1 - score_mean, score_mean + 1))) AS score_ci95,
              least(duration_ci95, greatest(0, least(1 - duration_mean, duration_mean + 1))) AS duration_ci95) FROM a""",
    ),
)
def seed_aggregates(spark, d):
    return X.seed_aggregates(runs(spark, d), ["score", "duration"])


@query(
    "E14_comparison_table",
    rounded(
        "best_score, mean_gap, repairs",
        f"""WITH {RUNS_SQL}, {LOG_SQL}, s AS (SELECT name, max(score) AS best_score, bool_or(success) AS success FROM runs GROUP BY name),
            g AS (SELECT 'exp_' || island AS name, avg(mean_gap) AS mean_gap FROM log WHERE event_type = 'candidate_evaluated' GROUP BY 1),
            r AS (SELECT name, sum(repairs)::DOUBLE AS repairs FROM runs WHERE status = 'failed' GROUP BY name)
            SELECT * FROM s LEFT JOIN g USING (name) LEFT JOIN r USING (name)""",
    ),
)
def comparison(spark, d):
    rows = runs(spark, d)
    base = rows.groupBy("name").agg(F.max("score").alias("best_score"), F.bool_or("success").alias("success"))
    gap = (
        event_log(spark, d).filter("event_type = 'candidate_evaluated'")
        .groupBy(F.concat(F.lit("exp_"), "island").alias("name")).agg(F.avg("mean_gap").alias("mean_gap"))
    )
    repair = rows.filter("status = 'failed'").groupBy("name").agg(F.sum("repairs").cast("double").alias("repairs"))
    return X.comparison_table(base, [gap, repair])


@query(
    "E10_factor_decomposition",
    rounded(
        "best_gain",
        """SELECT l_returnflag AS config, l_linestatus AS domain, count(DISTINCT l_linenumber) AS generations, max(l_extendedprice / 1e6) AS best_gain,
           max(l_suppkey) AS archive_size FROM lineitem GROUP BY ALL""",
    ),
)
def factors(spark, d):
    log = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("config"), F.col("l_linestatus").alias("domain"),
        F.col("l_linenumber").alias("generation"), (F.col("l_extendedprice") / 1e6).alias("gain"),
        F.col("l_suppkey").alias("archive_size"),
    )
    return X.factor_decomposition(log, ["config", "domain"])


@query(
    "E19_appendix_payload",
    rounded(
        "runtime_mean, runtime_std, runtime_ci95",
        f"""WITH {RUNS_SQL}, h AS (SELECT name AS grp, list(DISTINCT seed) FILTER (WHERE status = 'completed') AS have FROM runs GROUP BY name)
            SELECT r.name AS grp, count(*) AS n_runs, count(*) FILTER (WHERE status = 'completed') AS n_completed, count(*) FILTER (WHERE status = 'failed') AS n_failed,
              coalesce(array_to_string(list_filter(range(0, 20), lambda x: NOT coalesce(list_contains(any_value(have), x), false)), ', '), '') AS missing_seeds,
              sum(generations * islands * population + repairs)::BIGINT AS call_budget, {ci_sql('duration', 'runtime_')},
              count(*) FILTER (WHERE status = 'completed') < 5 AS small_data FROM runs r JOIN h ON h.grp = r.name GROUP BY r.name""",
    ),
)
def appendix(spark, d):
    rows = runs(spark, d).withColumn("grp", F.col("name"))
    return X.appendix_counts(rows, ["grp"], range(20))


@query(
    "E20_matrix_summary",
    rounded(
        "score_mean, score_std, score_ci95, duration_mean, duration_std, duration_ci95",
        f"""WITH {RUNS_SQL} SELECT grp, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
            count(*) FILTER (WHERE status = 'completed' AND success) AS success, count(*) FILTER (WHERE status = 'failed') AS failed,
            count(*) FILTER (WHERE status = 'running') AS open, {ci_sql('score', 'score_')}, {ci_sql('duration', 'duration_')} FROM runs GROUP BY grp""",
    ),
)
def matrix(spark, d):
    return X.matrix_summary(runs(spark, d), ["grp"])


@query(
    "E21_benchmark_summary",
    rounded(
        "success_rate",
        f"""WITH {RUNS_SQL} SELECT grp, count(*) AS n_runs, count(*) FILTER (WHERE success) AS success_count, avg(success::INTEGER) AS success_rate,
            count(*) FILTER (WHERE status = 'failed') AS failed_runs FROM runs GROUP BY grp""",
    ),
)
def benchmark(spark, d):
    return X.benchmark_summary(runs(spark, d), ["grp"])


@query(
    "E22_reeval_success",
    rounded(
        "success_rate, criterion",
        f"""WITH {RUNS_SQL} SELECT grp, count(*) AS n_runs, count(*) FILTER (WHERE score >= 0.85) AS success_count, avg((score >= 0.85)::INTEGER) AS success_rate,
            count(*) FILTER (WHERE status = 'failed') AS failed_runs, 0.85 AS criterion FROM runs GROUP BY grp""",
    ),
)
def reeval(spark, d):
    return X.reeval_success(runs(spark, d), ["grp"])


@query(
    "E23_runtime_stats",
    rounded(
        "mean, std",
        "SELECT o_orderpriority AS grp, count(*) AS n, avg((o_custkey % 600) / 10.0::DOUBLE) AS mean, stddev_pop((o_custkey % 600) / 10.0::DOUBLE) AS std FROM orders WHERE o_orderstatus <> 'P' GROUP BY grp",
    ),
)
def runtimes(spark, d):
    """Times read back out of ``real <sec>`` text lines."""
    tenths = F.col("o_custkey") % 600
    text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    lines = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("grp"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("real "), text)).otherwise(F.lit("user 0.1")).alias("value"),
    )
    return X.runtime_stats(lines, ["grp"])


@query(
    "E24_failure_modes",
    """SELECT o_orderpriority AS domain, CASE WHEN o_orderkey % 3 = 0 THEN 'remove_edge' ELSE 'add_edge' END AS proposal_type, o_orderstatus AS edge_type,
       CASE WHEN o_custkey % 10 = 0 THEN 'invalid' WHEN o_custkey % 7 > 3 THEN 'helpful' WHEN o_custkey % 7 < 3 THEN 'harmful' ELSE 'neutral' END AS effect,
       count(*) AS n FROM orders GROUP BY ALL""",
)
def failures(spark, d):
    c = F.col("o_custkey")
    rows = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("domain"),
        F.when(F.col("o_orderkey") % 3 == 0, "remove_edge").otherwise("add_edge").alias("proposal_type"),
        F.col("o_orderstatus").alias("edge_type"), (c % 10 != 0).alias("valid"), (c % 7 - 3).alias("hits_delta"),
    )
    return X.failure_modes(rows, ["domain"])


@query(
    "E25_regime_points",
    rounded(
        "price, x",
        f"""WITH {METRIC_SQL} SELECT domain, seed, price, 'volume' AS regime, volume AS x FROM mt UNION ALL SELECT domain, seed, price, 'spread', spread FROM mt""",
    ),
)
def regimes(spark, d):
    return X.regime_points(metric_table(spark, d), ["domain", "seed"], ["volume", "spread"], "price")


@query(
    "E31_success_criteria",
    f"""WITH {RUNS_SQL} SELECT run_id, score >= 0.85 AS meets_threshold, baseline_status = 'ok' AS baselines_healthy, score + 0.1 >= baseline_score AS baseline_parity,
        CASE WHEN fitness_mode <> 'correlation' THEN score >= 0.85 AND satisfaction_rate >= 0.95
          ELSE score >= 0.85 AND baseline_status = 'ok' AND score + 0.1 >= baseline_score END AS success FROM runs""",
)
def criteria(spark, d):
    rows = runs(spark, d).drop("success")
    return X.success_criteria(rows, parity=0.1).select(
        "run_id", "meets_threshold", "baselines_healthy", "baseline_parity", "success"
    )


SPLITS_SQL = """a AS (SELECT o_orderpriority AS split, o_orderkey // 1024 AS p1, count(*) AS n,
   sha256(string_agg(o_orderkey || ':' || o_custkey, ',' ORDER BY o_orderkey)) AS h FROM orders GROUP BY ALL),
b AS (SELECT split, p1 // 1024 AS p2, sum(n) AS n, sha256(string_agg(h, ',' ORDER BY p1)) AS h FROM a GROUP BY ALL),
c AS (SELECT split, p2 // 1024 AS p3, sum(n) AS n, sha256(string_agg(h, ',' ORDER BY p2)) AS h FROM b GROUP BY ALL),
splits AS (SELECT split, sha256(string_agg(h, ',' ORDER BY p3)) AS fingerprint, sum(n)::BIGINT AS n FROM c GROUP BY split)"""
#: Fields of the run that the fingerprint of a whole dataset holds beside its splits.
DATASET = {"seed": 42, "target_name": "o_custkey", "model_name": "orders"}


@query(
    "E32_dataset_fingerprint",
    f"WITH {SPLITS_SQL} SELECT split, fingerprint, n FROM splits",
)
def fingerprints(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("split"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("y")
    )
    return X.fingerprint(rows, ["split"], "pos", "y")


@query(
    "E32_dataset_identity",
    f"""WITH {SPLITS_SQL}, lines AS (SELECT split || ':' || n || ':' || fingerprint AS line, n FROM splits)
       SELECT sha256('{json.dumps(DATASET, sort_keys=True)}|' || string_agg(line, ',' ORDER BY line)) AS dataset, count(*) AS n_splits,
         sum(n)::BIGINT AS n FROM lines""",
)
def dataset_identity(spark, d):
    """One fingerprint of the configuration and all splits."""
    return X.dataset_fingerprint(fingerprints(spark, d), [], "split", DATASET)


PAIRED_SQL = """pa AS (SELECT o_orderpriority AS domain, month(o_orderdate)::INTEGER AS seed, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / 1e6 AS a,
   avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) / 1e6 AS b FROM orders GROUP BY ALL)"""


def paired(spark, d):
    price = F.col("o_totalprice") / 1e6
    return table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("domain"), F.month("o_orderdate").alias("seed")
    ).agg(
        F.avg(F.when(F.col("o_orderstatus") == "F", price)).alias("a"),
        F.avg(F.when(F.col("o_orderstatus") == "O", price)).alias("b"),
    )


@query("J6_model_vs_baseline", rounded("a, b, diff", f"WITH {PAIRED_SQL} SELECT domain, seed, a, b, a - b AS diff FROM pa"))
def versus(spark, d):
    rows = paired(spark, d)
    return X.model_vs_baseline(rows.select("domain", "seed", "a"), rows.select("domain", "seed", "b"), ["domain", "seed"])


RAW_SQL = """raw AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'False' WHEN 2 THEN ' 12 ' WHEN 3 THEN '1.5' WHEN 4 THEN 'n/a' WHEN 5 THEN NULL
   ELSE '-3' END AS s FROM events)"""


def raw_statuses(spark, d):
    e = F.col("event_id") % 7
    return table(spark, d, "events").select(
        "event_id",
        F.when(e == 0, "true").when(e == 1, "False").when(e == 2, " 12 ").when(e == 3, "1.5").when(e == 4, "n/a")
        .when(e == 6, "-3").alias("s"),
    )


@query(
    "P10_status_parse",
    f"""WITH {RAW_SQL} SELECT event_id, CASE WHEN regexp_matches(trim(s), '^[+-]?[0-9]+$') THEN trim(s)::BIGINT ELSE 1 END AS code,
        coalesce((event_id % 2 = 0)::BIGINT, 1) AS flag_code, event_id * 1000 AS int_code FROM raw""",
)
def statuses(spark, d):
    """Codes from text, from real booleans and from integers."""
    raw = raw_statuses(spark, d).withColumn("flag", F.col("event_id") % 2 == 0).withColumn("number", F.col("event_id") * 1000)
    return raw.select("event_id", status_code(raw, "s").alias("code"), status_code(raw, "flag").alias("flag_code"),
                      status_code(raw, "number").alias("int_code"))


@query(
    "P11_safe_numeric",
    rounded(
        "value, zeroed, typed",
        f"""WITH {RAW_SQL} SELECT event_id, CASE WHEN lower(s) NOT IN ('true', 'false') THEN try_cast(trim(s) AS DOUBLE) END AS value,
            coalesce(CASE WHEN lower(s) NOT IN ('true', 'false') THEN try_cast(trim(s) AS DOUBLE) END, 0) AS zeroed,
            event_id::DOUBLE AS typed, NULL::DOUBLE AS typed_text FROM raw""",
    ),
)
def numerics(spark, d):
    """Text read as numbers, and the typed rule, by which text is never one."""
    raw = raw_statuses(spark, d)
    value = parsed_float(F.col("s"))
    return raw.select("event_id", value.alias("value"), finite(value).alias("zeroed"),
                      safe_float(raw, "event_id").alias("typed"), safe_float(raw, "s").alias("typed_text"))
