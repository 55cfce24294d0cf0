"""Link-prediction baselines and ranked-list metrics.

A rank is computed as counts (how many targets score higher, how many tie),
never by materialising every target of every test edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.keys import hash_int, text_hash
from edgeloom.functions.numeric import clamp, harmonic_number
from edgeloom.operators.structure import edge_source_type

MIN_TRAIN_EDGES = 10


def freq_table(train: DataFrame, entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often each target follows (source type, edge type) in training."""
    return (
        edge_source_type(train, entities, keys)
        .groupBy(*keys, "source_type", "et", "dst")
        .agg(F.count("*").alias("c"))
    )


def _split_sizes(split: DataFrame, keys: Sequence[str]) -> DataFrame:
    return split.groupBy(*keys).agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
    )


def frequency_ranks(split: DataFrame, entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per distinct test query: ``greater`` and ``equal`` target counts and weight ``w``."""
    keys = list(keys)
    table = freq_table(split.filter("split = 'train'"), entities, keys)
    group = [*keys, "source_type", "et"]
    levels = table.groupBy(*group, "c").agg(F.count("*").alias("m"))
    above = Window.partitionBy(*group).orderBy(F.desc("c")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    levels = levels.withColumn("above", F.coalesce(F.sum("m").over(above), F.lit(0)))
    seen = levels.groupBy(*group).agg(F.sum("m").alias("seen"))
    sizes = entities.groupBy(*keys).agg(F.count("*").alias("n_entities"))
    tests = (
        edge_source_type(split.filter("split = 'test'"), entities, keys)
        .groupBy(*group, "dst")
        .agg(F.count("*").alias("w"))
    )
    known = entities.select(*keys, F.col("id").alias("dst"))
    return (
        tests.join(known, [*keys, "dst"], "left_semi")
        .join(table, [*group, "dst"], "left")
        .join(levels, [*group, "c"], "left")
        .join(seen, group, "left")
        .join(sizes, keys)
        .select(
            *group,
            "dst",
            "w",
            "n_entities",
            F.coalesce("above", "seen", F.lit(0)).alias("greater"),
            F.coalesce("m", F.col("n_entities") - F.coalesce("seen", F.lit(0))).alias("equal"),
        )
    )


def expected_hit(greater: Column, equal: Column, k_eff: Column) -> Column:
    """Chance to be in the top k when ties are ordered at random."""
    return clamp((k_eff - greater) / equal)


def expected_reciprocal(greater: Column, equal: Column) -> Column:
    """Mean of 1/rank over a random order of the ties."""
    return (harmonic_number(greater + equal) - harmonic_number(greater)) / equal


def frequency_metrics(
    split: DataFrame, entities: DataFrame, keys: Sequence[str], k: int = 10
) -> DataFrame:
    """``hits`` and ``mrr`` of the frequency baseline; 0 below ten training edges."""
    keys = list(keys)
    ranks = frequency_ranks(split, entities, keys)
    k_eff = F.least(F.lit(k), F.col("n_entities") - 1)
    sums = ranks.groupBy(*keys).agg(
        F.sum(F.col("w") * expected_hit(F.col("greater"), F.col("equal"), k_eff)).alias("hits"),
        F.sum(F.col("w") * expected_reciprocal(F.col("greater"), F.col("equal"))).alias("rr"),
    )
    return _score_sums(sums, split, keys)


def _score_sums(sums: DataFrame, split: DataFrame, keys: list[str]) -> DataFrame:
    usable = (F.col("n_train") >= MIN_TRAIN_EDGES) & (F.col("n_test") > 0)
    return (
        _split_sizes(split, keys)
        .join(sums, keys, "left")
        .select(
            *keys,
            F.when(usable, F.coalesce("hits", F.lit(0.0)) / F.col("n_test"))
            .otherwise(F.lit(0.0))
            .alias("hits"),
            F.when(usable, F.coalesce("rr", F.lit(0.0)) / F.col("n_test"))
            .otherwise(F.lit(0.0))
            .alias("mrr"),
        )
    )


def random_metrics(
    split: DataFrame, entities: DataFrame, keys: Sequence[str], k: int = 10, seed: int = 42
) -> DataFrame:
    """The uniform baseline: a hashed rank per test edge, and its closed forms."""
    keys = list(keys)
    sizes = entities.groupBy(*keys).agg(F.count("*").alias("n_entities"))
    tests = split.filter("split = 'test'").join(sizes, keys)
    draw = hash_int(text_hash(F.lit(seed), F.lit("rank"), *keys, "src", "dst", "et", "copy"))
    rank = draw % F.col("n_entities") + 1
    k_eff = F.least(F.lit(k), F.col("n_entities") - 1)
    sums = tests.groupBy(*keys).agg(
        F.sum((rank <= k_eff).cast("double")).alias("hits"), F.sum(1.0 / rank).alias("rr")
    )
    n = F.col("n_entities")
    return (
        _score_sums(sums, split, keys)
        .join(sizes, keys)
        .select(
            *keys,
            "hits",
            "mrr",
            (F.least(F.lit(k), n - 1) / n).alias("expected_hits"),
            (harmonic_number(n) / n).alias("expected_mrr"),
        )
    )


def rank_metrics(ranks: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """Hits@k and MRR from ``(keys…, rank, w, n_entities)``; denominator = all test edges."""
    k_eff = F.least(F.lit(k), F.col("n_entities") - 1)
    ranked = F.col("rank").isNotNull()
    return ranks.groupBy(*keys).agg(
        (F.sum(F.col("w") * (ranked & (F.col("rank") <= k_eff)).cast("double")) / F.sum("w")).alias(
            "hits"
        ),
        F.coalesce(
            F.sum(F.when(ranked, F.col("w") / F.col("rank")))
            / F.nullif(F.sum(F.when(ranked, F.col("w"))), F.lit(0)),
            F.lit(0.0),
        ).alias("mrr"),
    )


# ------------------------------------------------------------- ranked proposals

TRIPLE = ["src", "dst", "et"]


def first_occurrences(ranked: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` distinct triples by ``pos``, numbered from 1.

    Duplicates collapse map-side; the bounded rank is limited before its shuffle.
    """
    firsts = ranked.groupBy(*keys, *TRIPLE).agg(F.min("pos").alias("pos"))
    order = Window.partitionBy(*keys).orderBy("pos", *TRIPLE)
    return firsts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def _cutoffs(df: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    values = F.array(*[F.lit(int(n)) for n in cutoffs])
    return df.select("*", F.explode(values).alias("n"))


def backtest(
    ranked: DataFrame,
    hidden: DataFrame,
    keys: Sequence[str],
    cutoffs: Sequence[int] = (5, 10, 20),
) -> DataFrame:
    """Precision and recall of ranked proposals against hidden triples, per cutoff.

    Precision divides by the distinct proposals actually within the cutoff;
    recall by the distinct hidden triples.
    """
    keys = list(keys)
    truth = hidden.select(*keys, *TRIPLE).distinct()
    totals = truth.groupBy(*keys).agg(F.count("*").alias("n_hidden"))
    proposed = ranked.groupBy(*keys).agg(F.count("*").alias("n_proposals"))
    matched = (
        ranked.select(*keys, *TRIPLE)
        .distinct()
        .join(truth, [*keys, *TRIPLE], "left_semi")
        .groupBy(*keys)
        .agg(F.count("*").alias("n_matched"))
    )
    top = first_occurrences(ranked, keys, max(cutoffs))
    flagged = top.join(truth.withColumn("hit", F.lit(1)), [*keys, *TRIPLE], "left")
    per_cut = (
        _cutoffs(flagged, cutoffs)
        .filter(F.col("place") <= F.col("n"))
        .groupBy(*keys, "n")
        .agg(F.count("hit").alias("hits"), F.count("*").alias("shown"))
    )
    graphs = ranked.select(*keys).unionByName(hidden.select(*keys)).distinct()
    base = _cutoffs(graphs, cutoffs)
    return (
        base.join(per_cut, [*keys, "n"], "left")
        .join(totals, keys, "left")
        .join(proposed, keys, "left")
        .join(matched, keys, "left")
        .select(
            *keys,
            "n",
            F.coalesce(F.col("hits") / F.col("shown"), F.lit(0.0)).alias("precision"),
            F.coalesce(F.col("hits") / F.col("n_hidden"), F.lit(0.0)).alias("recall"),
            F.coalesce("n_proposals", F.lit(0)).alias("n_proposals"),
            F.coalesce("n_hidden", F.lit(0)).alias("n_hidden"),
            F.coalesce("n_matched", F.lit(0)).alias("n_matched"),
        )
    )


def matched_triples(ranked: DataFrame, hidden: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct ranked triples that are hidden edges, with their first position."""
    truth = hidden.select(*keys, *TRIPLE).distinct()
    firsts = ranked.groupBy(*keys, *TRIPLE).agg(F.min("pos").alias("pos"))
    return firsts.join(truth, [*keys, *TRIPLE], "left_semi")


def soft_flags(
    triples: DataFrame, others: DataFrame, keys: Sequence[str], name: str = "soft"
) -> DataFrame:
    """Flag triples sharing (src, et) or (et, dst) with any of ``others``.

    Two equi-joins and an OR of their flags; an OR join would be a nested loop.
    """
    keys = list(keys)
    by_src = others.select(*keys, "src", "et").distinct().withColumn("_s", F.lit(True))
    by_dst = others.select(*keys, "et", "dst").distinct().withColumn("_t", F.lit(True))
    return (
        triples.join(by_src, [*keys, "src", "et"], "left")
        .join(by_dst, [*keys, "et", "dst"], "left")
        .withColumn(name, F.coalesce("_s", F.lit(False)) | F.coalesce("_t", F.lit(False)))
        .drop("_s", "_t")
    )


def soft_backtest(
    ranked: DataFrame,
    hidden: DataFrame,
    keys: Sequence[str],
    cutoffs: Sequence[int] = (5, 10, 20),
) -> DataFrame:
    """Neighbourhood precision/recall; recall counts hidden rows, not distinct triples."""
    keys = list(keys)
    top = first_occurrences(ranked, keys, max(cutoffs))
    precise = (
        _cutoffs(soft_flags(top, hidden, keys), cutoffs)
        .filter(F.col("place") <= F.col("n"))
        .groupBy(*keys, "n")
        .agg(F.avg(F.col("soft").cast("double")).alias("soft_precision"))
    )
    # A hidden edge is covered from the best place of a matching proposal onwards.
    best_src = top.groupBy(*keys, "src", "et").agg(F.min("place").alias("_ps"))
    best_dst = top.groupBy(*keys, "et", "dst").agg(F.min("place").alias("_pt"))
    weights = hidden.groupBy(*keys, *TRIPLE).agg(F.count("*").alias("w"))
    covered = (
        weights.join(best_src, [*keys, "src", "et"], "left")
        .join(best_dst, [*keys, "et", "dst"], "left")
        .groupBy(*keys)
        .agg(
            F.sum("w").alias("n_hidden"),
            *[
                F.sum(
                    F.when(F.coalesce(F.least("_ps", "_pt"), F.lit(2**31)) <= n, F.col("w")).otherwise(0)
                ).alias(f"c{n}")
                for n in cutoffs
            ],
        )
    )
    rows = F.array(
        *[F.struct(F.lit(int(n)).alias("n"), F.col(f"c{n}").alias("covered")) for n in cutoffs]
    )
    covered = covered.select(*keys, "n_hidden", F.inline(rows))
    graphs = ranked.select(*keys).unionByName(hidden.select(*keys)).distinct()
    proposed = ranked.groupBy(*keys).agg(F.count("*").alias("n_proposals"))
    return (
        _cutoffs(graphs, cutoffs)
        .join(precise, [*keys, "n"], "left")
        .join(covered, [*keys, "n"], "left")
        .join(proposed, keys, "left")
        .select(
            *keys,
            "n",
            F.coalesce("soft_precision", F.lit(0.0)).alias("soft_precision"),
            F.coalesce(F.col("covered") / F.col("n_hidden"), F.lit(0.0)).alias("soft_recall"),
            F.coalesce("n_proposals", F.lit(0)).alias("n_proposals"),
            F.coalesce("n_hidden", F.lit(0)).alias("n_hidden"),
        )
    )


def classify_proposals(proposals: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rediscovery`` when the exact typed edge is already in the graph, else ``novel``."""
    known = (
        edges.select(
            *keys,
            F.col("src").alias("source_entity"),
            F.col("dst").alias("target_entity"),
            F.upper("et").alias("_name"),
        )
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    tagged = proposals.withColumn("_name", F.upper("edge_type"))
    return (
        tagged.join(known, [*keys, "source_entity", "target_entity", "_name"], "left")
        .withColumn(
            "label", F.when(F.col("_known"), F.lit("rediscovery")).otherwise(F.lit("novel"))
        )
        .drop("_name", "_known")
    )


def classify_counts(classified: DataFrame, keys: Sequence[str]) -> DataFrame:
    return classified.groupBy(*keys).agg(
        F.count_if(F.col("label") == "rediscovery").alias("rediscovery"),
        F.count_if(F.col("label") == "novel").alias("novel"),
        F.count("*").alias("total"),
    )
