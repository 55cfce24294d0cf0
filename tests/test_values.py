"""Closed forms and brute force for invariants, ranks, statistics, logs and text."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import numeric as N
from edgeloom.functions import text as X
from edgeloom.functions.keys import ordered_positions, hash_bucket, text_hash, expand_copies
from edgeloom.operators import archive as A
from edgeloom.operators import embeddings as E
from edgeloom.operators import formulas as M
from edgeloom.operators import invariants as I
from edgeloom.operators import logs as L
from edgeloom.operators import ranking as R
from edgeloom.operators import statistics as B
from edgeloom.plans.calibration import calibration_verdict


@pytest.fixture(scope="module")
def corpus(spark):
    graphs = {
        "path": (6, [(i, i + 1) for i in range(5)]),
        "cycle": (7, [(i, (i + 1) % 7) for i in range(7)]),
        "complete": (5, [(i, j) for i in range(5) for j in range(i)]),
        "star": (8, [(0, i) for i in range(1, 8)]),
        "split": (4, [(0, 1), (2, 3)]),
        "single": (1, []),
    }
    nodes = spark.createDataFrame([(g, f"v{i}") for g, (n, _) in graphs.items() for i in range(n)], "graph_id string, v string")
    edges = spark.createDataFrame(
        [(g, f"v{a}", f"v{b}") for g, (_, e) in graphs.items() for a, b in e], "graph_id string, u string, v string"
    )
    return nodes, edges


def test_invariants_closed_forms(corpus):
    rows = {r["graph_id"]: r for r in I.invariant_matrix(*corpus).collect()}
    assert rows["complete"]["density"] == 1 and rows["complete"]["avg_clustering"] == 1
    assert rows["complete"]["num_triangles"] == 10 and rows["complete"]["transitivity"] == 1
    assert rows["complete"]["algebraic_connectivity"] == pytest.approx(5)
    assert rows["complete"]["spectral_radius"] == pytest.approx(4)
    assert rows["star"]["spectral_radius"] == pytest.approx(math.sqrt(7))
    assert rows["star"]["degree_assortativity"] == pytest.approx(-1)
    assert rows["cycle"]["degree_assortativity"] == 0 and rows["cycle"]["num_triangles"] == 0
    assert rows["path"]["algebraic_connectivity"] == pytest.approx(2 - 2 * math.cos(math.pi / 6))
    assert rows["split"]["algebraic_connectivity"] == 0 and rows["single"]["density"] == 0


def test_paths(corpus):
    rows = {r["graph_id"]: r for r in I.path_targets(I.distances(*corpus)).collect()}
    assert rows["path"]["average_shortest_path_length"] == pytest.approx(7 / 3) and rows["path"]["diameter"] == 5
    assert rows["cycle"]["diameter"] == 3 and rows["complete"]["average_shortest_path_length"] == 1
    assert rows["split"]["average_shortest_path_length"] == 0 and rows["single"]["diameter"] == 0


def test_paths_and_spectra_of_the_largest_component(spark, monkeypatch):
    """A path of four beside a triangle and a lone node; two equal components: the one with the smallest name."""
    rows = {"p": [("b", "c"), ("c", "d"), ("d", "e"), ("d", "c"), ("x", "y"), ("y", "z"), ("x", "z")], "t": [("a", "k"), ("k", "m"), ("b", "c"), ("c", "d"), ("b", "d")]}
    edges = spark.createDataFrame([(g, a, b) for g, e in rows.items() for a, b in e], "graph_id string, u string, v string")
    nodes = edges.selectExpr("graph_id", "inline(array(struct(u AS v), struct(v AS v)))").distinct()
    nodes = nodes.unionByName(spark.createDataFrame([("p", "a")], "graph_id string, v string"))
    want = {"p": (4, 12, 20, 3), "t": (3, 6, 8, 2)}
    for most in (I.MOST_NODES, 5):  # with 5 both graphs go by rounds over the cluster, or only one
        monkeypatch.setattr(I, "MOST_NODES", most)
        got = {r["graph_id"]: (r["n"], r["reached"], r["dist_sum"], r["ecc"]) for r in I.distances(nodes, edges, largest=True).collect()}
        assert got == want
    monkeypatch.setattr(I, "MOST_NODES", 7)
    assert {tuple(r) for r in I.distances(nodes, edges).collect()} == {tuple(r) for r in I.wide_distances(nodes, edges).collect()}
    monkeypatch.setattr(I, "SEARCH_WORDS", 1)
    assert I._graph_distances(200, *np.array([(i, j) for i in range(200) for j in (i - 1, i + 1) if 0 <= j < 200]).T) == (
        200 * 199, sum(2 * k * (200 - k) for k in range(200)), 199)
    monkeypatch.setattr(I, "MOST_NODES", 4096)
    got = {r["graph_id"]: r["algebraic_connectivity"] for r in I.spectra(nodes, edges, ["algebraic_connectivity"], largest=True).collect()}
    assert got == pytest.approx({"p": 2 - math.sqrt(2), "t": 1.0})


def test_spectra_have_one_method_and_a_limit(spark):
    n = 2000
    rows = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(0, i) for i in range(1, n)]}
    nodes = spark.createDataFrame([(g, f"v{i}") for g in rows for i in range(n)], "graph_id string, v string")
    edges = spark.createDataFrame([(g, f"v{a}", f"v{b}") for g, e in rows.items() for a, b in e], "graph_id string, u string, v string")
    got = {r["graph_id"]: r for r in I.spectra(nodes, edges).collect()}
    assert got["path"]["algebraic_connectivity"] == pytest.approx(2 - 2 * math.cos(math.pi / n), abs=1e-9)
    assert got["path"]["spectral_radius"] == pytest.approx(2 * math.cos(math.pi / (n + 1)), abs=1e-9)
    assert got["star"]["laplacian_max"] == pytest.approx(n) and got["star"]["algebraic_connectivity"] == pytest.approx(1)
    assert got["star"]["laplacian_energy_ratio"] == pytest.approx((n + 4) / (2 * (n - 1)))
    large = spark.range(I.MOST_NODES + 1).select(F.lit("g").alias("graph_id"), F.col("id").cast("string").alias("v"))
    with pytest.raises(Exception, match="limited to"):
        I.spectra(large, edges.limit(0)).collect()


@pytest.mark.parametrize("model", E.MODELS)
def test_target_ranks_match_brute_force(spark, model):
    rng = np.random.default_rng(5)
    ents = {f"e{i:02d}": rng.normal(size=6) for i in range(20)}
    ents["e19"] = ents["e03"].copy()
    rels = {"r0": rng.normal(size=3 if model == "rotate" else 6), "r1": rng.normal(size=3 if model == "rotate" else 6)}
    triples = [(f"e{rng.integers(20):02d}", f"r{rng.integers(2)}", f"e{rng.integers(20):02d}") for _ in range(15)]
    vectors = spark.createDataFrame([("g", k, v.tolist()) for k, v in ents.items()], "domain string, id string, vec array<double>")
    relations = spark.createDataFrame([("g", k, v.tolist()) for k, v in rels.items()], "domain string, et string, vec array<double>")
    df = spark.createDataFrame([("g", *t) for t in triples], "domain string, src string, et string, dst string")
    got = {(r["src"], r["et"], r["dst"]): r["rank"] for r in E.target_ranks(df, vectors, relations, ["domain"], model, block=7).collect()}
    scored = df.distinct().withColumnRenamed("dst", "true").join(vectors.select("domain", F.col("id").alias("dst")), "domain")
    rows = E.score_triples(scored, vectors, relations, ["domain"], model).collect()
    table = {}
    for r in rows:
        table.setdefault((r["src"], r["et"], r["true"]), {})[r["dst"]] = round(r["score"], 9)
    for (s, t, d), scores in table.items():
        want = 1 + sum(1 for k, v in scores.items() if v > scores[d] or (v == scores[d] and k < d))
        assert got[s, t, d] == want


def test_best_places_keep_ties_and_put_nan_last():
    rng = np.random.default_rng(8)
    scores = np.round(rng.normal(size=(30, 40)), 0)
    scores[3, :38] = np.nan
    scores[4] = np.nan
    for ids in (rng.permutation(40), np.array([f"e{i:02d}" for i in rng.permutation(40)], dtype=object)):
        for k in (1, 5, 40, 60):
            row, col = E.best_places(scores, ids, k)
            for i in range(30):
                assert col[row == i].tolist() == np.lexsort((ids, -scores[i]))[:k].tolist()


@pytest.mark.parametrize("model", ["distmult", "transe"])
def test_slices_of_a_cell_change_nothing(spark, model, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [("g", f"e{i:02d}", rng.integers(-2, 3, size=4).astype(float).tolist()) for i in range(30)]
    vectors = spark.createDataFrame(rows, "domain string, id string, vec array<double>")
    relations = spark.createDataFrame([("g", "r", [1.0, 0.0, 2.0, 1.0])], "domain string, et string, vec array<double>")
    df = spark.createDataFrame([("g", f"e{i:02d}", "r", f"e{i * 7 % 30:02d}") for i in range(30)], "domain string, src string, et string, dst string")
    assert E.HELD_SCORES > 30 * 30
    whole = [E.top_targets(df, vectors, relations, ["domain"], model, k=4).collect(), E.target_ranks(df, vectors, relations, ["domain"], model).collect()]
    monkeypatch.setattr(E, "HELD_SCORES", 100)
    cut = [E.top_targets(df, vectors, relations, ["domain"], model, k=4).collect(), E.target_ranks(df, vectors, relations, ["domain"], model).collect()]
    assert [sorted(map(tuple, x)) for x in cut] == [sorted(map(tuple, x)) for x in whole] and len(whole[0]) == 120


def test_training_lowers_loss(spark):
    names = [f"n{i}" for i in range(12)]
    ents = spark.createDataFrame([("g", n, "x") for n in names], "domain string, id string, entity_type string")
    edges = spark.createDataFrame([("g", names[i], names[(i + 3) % 12], "derives") for i in range(12)], "domain string, src string, dst string, et string")
    vectors, _, losses = E.train(edges, ents, ["domain"], "transe", dim=6, epochs=4, lr=0.1, negatives=2)
    loss = [r["loss"] for r in losses.orderBy("epoch").collect()]
    assert loss[-1] < loss[0]
    norm = vectors.select(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1) for r in norm)


def test_backtest_cases(spark):
    ranked = spark.createDataFrame(
        [("a", 1, "x", "y", "t"), ("a", 2, "x", "y", "t"), ("a", 3, "p", "q", "t"), ("b", 1, "x", "z", "t")],
        "k string, pos int, src string, dst string, et string",
    )
    hidden = spark.createDataFrame(
        [("a", "x", "y", "t"), ("a", "x", "y", "t"), ("a", "m", "n", "t"), ("c", "m", "n", "t")],
        "k string, src string, dst string, et string",
    )
    rows = {(r["k"], r["n"]): r for r in R.backtest(ranked, hidden, ["k"]).collect()}
    assert rows["a", 5]["precision"] == 0.5 and rows["a", 5]["recall"] == 0.5
    assert rows["a", 5]["n_proposals"] == 3 and rows["a", 5]["n_hidden"] == 2
    assert rows["b", 5]["precision"] == 0 and rows["c", 20]["recall"] == 0
    soft = {(r["k"], r["n"]): r for r in R.soft_backtest(ranked, hidden, ["k"]).collect()}
    assert soft["a", 5]["soft_recall"] == pytest.approx(2 / 3) and soft["a", 5]["n_hidden"] == 3


def test_statistics(spark):
    values = spark.createDataFrame([("one", 0.5), ("three", 0.1), ("three", 0.2), ("three", 0.3)], "g string, x double")
    rows = {r["g"]: r for r in B.mean_std_ci95(values, ["g"], "x").collect()}
    assert rows["one"]["std"] == 0 and rows["one"]["ci95"] == 0
    assert rows["three"]["ci95"] == pytest.approx(4.303 * 0.1 / math.sqrt(3))
    sides = spark.createDataFrame([("d", "a", 3.0), ("d", "a", 4.0), ("d", "b", 1.0), ("d", "b", 2.0)], "g string, s string, v double")
    assert B.cliffs_delta(sides, ["g"], "s", "v").first()["delta"] == 1
    flat = spark.createDataFrame([("c", i, 1.0, 1.0) for i in range(5)], "g string, i int, a double, b double")
    row = B.paired_bootstrap_ci(flat, ["g"], "a", "b", ["i"], replicates=50).first()
    assert row["mean_diff"] == 0 and row["p_value"] == 1.0
    const = B.spearman(flat, ["g"], "a", "i").first()["spearman"]
    assert math.isnan(const)


def test_ranks_of_values_that_differ_on_every_evaluation(spark):
    """Every row keeps its rank although a second evaluation of the values would give others."""
    drawn = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    rows = spark.range(40).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 4 < 2, "a").otherwise("b").alias("s"), drawn().alias("v"))
    ranks = B.average_rank(rows, ["g"], "v", "r").collect()
    assert sorted(r["r"] for r in ranks if r["g"] == 0) == [float(i) for i in range(1, 21)]
    assert B.cliffs_delta(rows, ["g"], "s", "v").count() == 2


def test_ordered_positions_and_copies(spark):
    rows = spark.createDataFrame([(f"k{i % 2}", i) for i in range(500)], "k string, i int")
    hashed = rows.withColumn("h", text_hash("k", "i"))
    got = ordered_positions(hashed, ["k"], ["h"], hash_bucket("h", 1)).collect()
    for k in ("k0", "k1"):
        mine = sorted((r["h"], r["pos"]) for r in got if r["k"] == k)
        assert [p for _, p in mine] == list(range(1, 251))
    copies = spark.createDataFrame([("x", 7), ("y", 1)], "k string, n int")
    out = [(r["k"], r["c"]) for r in expand_copies(copies, "n", "c", chunk=3).collect()]
    assert sorted(out) == [("x", i) for i in range(1, 8)] + [("y", 1)]


# v: a valid generation, x: an invalid one; below it f: free, c: constrained, worked out by hand.
MODES = [
    ("reset", "xxxxxxxx", "ffffccff"),  # the seventh in a row ends the span and starts over
    ("reset", "xxxxxvxxxxx", "ffffcfffffc"),
    ("reset", "vxxxxvxxxxxxx", "ffffffffffccf"),
    ("lock", "xxxxxxxxv", "ffffccccf"),  # freed within the span
    ("lock", "xxxxxxxxxvxv", "ffffcccccccc"),  # one generation too late: it stays
    ("lock", "xxxxxvxxxxx", "ffffcfffffc"),
    ("lock", "vvvv", "ffff"),
]


@pytest.mark.parametrize("rule", ["reset", "lock"])
def test_stagnation_modes_worked_by_hand(spark, rule):
    logs = [(f"i{k}", made, want) for k, (r, made, want) in enumerate(MODES) if r == rule]
    rows = [(k, g, c == "v") for k, made, _ in logs for g, c in enumerate(made)]
    turns = spark.createDataFrame(rows, "isl string, generation int, valid boolean")
    got = L.stagnation_mode(turns, ["isl"], F.floor(F.col("generation") / 7), rule).collect()
    for k, _, want in logs:
        mine = [r["mode"][0] for r in sorted((r for r in got if r["isl"] == k), key=lambda r: r["generation"])]
        assert "".join(mine) == want


def test_status_and_numbers_follow_the_column_type(spark):
    rows = [(1, "false", True, 7), (2, " 12 ", False, None), (3, "123456789012", None, 1), (4, "1.5", True, 2)]
    df = spark.createDataFrame(rows, "i int, s string, b boolean, n long")
    got = df.select(N.status_code(df, "s").alias("s"), N.status_code(df, "b").alias("b"), N.status_code(df, "n").alias("n"),
                    N.safe_float(df, "s").alias("fs"), N.safe_float(df, "b").alias("fb"), N.safe_float(df, "n").alias("fn"),
                    N.parsed_float(F.col("s")).alias("p")).collect()
    assert [r["s"] for r in got] == [1, 12, 123456789012, 1]
    assert [r["b"] for r in got] == [1, 0, 1, 1] and [r["n"] for r in got] == [7, 1, 1, 2]
    assert {r["fs"] for r in got} == {r["fb"] for r in got} == {None}
    assert [r["fn"] for r in got] == [7.0, None, 1.0, 2.0] and got[3]["p"] == 1.5


def test_scores_are_cut_off_and_read_from_the_first_flat_braces(spark):
    texts = ['{"a": 4.5, "b": 1}', '{not json} {"a": 1, "b": 2}', '{"a": 5.9}', '{"a": 0.9, "b": 6}', 'x {"k": {"a": 3, "b": 3}}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("j", X.flat_object(F.col("t")))
    got = {r["i"]: (r["error"], r["a"], r["b"]) for r in X.parse_scores(df, "j", ["a", "b"]).collect()}
    assert got == {0: (None, 4, 1), 1: ("no_json", None, None), 2: ("missing:b", None, None), 3: ("range:a,b", None, None),
                   4: (None, 3, 3), 5: ("no_json", None, None)}


def test_calibration_verdict_needs_two_graphs_and_the_whole_grid(spark):
    rows = [("a", "x", True, True), ("a", "y", True, True), ("a", "z", False, True), ("b", "x", True, True), ("b", "y", False, True),
            ("c", "x", True, True), ("c", "y", True, False)]
    gate = spark.createDataFrame(rows, "run string, domain string, passes boolean, grid_beats boolean")
    got = {r["run"]: (r["n_passing"], r["verdict"]) for r in calibration_verdict(gate, ["run"]).collect()}
    assert got == {"a": (2, True), "b": (1, False), "c": (2, False)}


def test_archive_ties_and_flags(spark):
    old = spark.createDataFrame([("a", 0, 0, 1.0, "old")], "k string, row int, col int, fitness double, item string")
    batch = spark.createDataFrame(
        [("a", 0, 0, 1.0, "tie", 1), ("a", 0, 0, 2.0, "first", 2), ("a", 0, 0, 2.0, "second", 3), ("a", 1, 0, None, "none", 4)],
        "k string, row int, col int, fitness double, item string, seq int",
    )
    assert A.archive_upsert(old, batch, ["k"]).first()["item"] == "first"
    flags = {r["item"]: r["inserted"] for r in A.inserted_flags(old, batch, ["k"], F.floor(F.col("seq") / 2)).collect()}
    assert flags == {"tie": False, "first": True, "second": False}


def test_bound_metrics_and_total(spark):
    rows = spark.createDataFrame([("c", 1.0, 2.0), ("c", 1.0, 1.0), ("c", 2.0, 1.0)], "candidate string, y double, pred double")
    row = M.bound_metrics(rows, ["candidate"], "upper_bound").first()
    assert row["satisfaction_rate"] == pytest.approx(2 / 3) and row["mean_gap"] == pytest.approx(0.5)
    total = spark.range(1).select(M.total_score(F.lit(0.9), F.lit(0.5), F.lit(0.25)).alias("t")).first()["t"]
    assert total == pytest.approx(0.69)


def test_text(spark):
    rows = spark.createDataFrame(
        [(1, 'say {no} {"a": {"b": 1}} end'), (2, '```json\n{"x": 1}\n``` {"y": 2}'), (3, "none"), (4, None), (5, "```{bad}``` [1] {\"k\": 2}")],
        "id int, t string",
    )
    got = {r["id"]: r["json"] for r in X.extract_json(rows, "t").collect()}
    assert got == {1: '{"a": {"b": 1}}', 2: '{"x": 1}', 3: None, 4: None, 5: '{"k": 2}'}
    one = spark.createDataFrame([("we never  measure 5 nm",)], "t string")
    score = one.select(X.falsification_score(F.col("t")).alias("s")).first()["s"]
    assert score == pytest.approx(0.6 / (1 + math.exp(-0.15 * (5 - 10))) + 0.4 * 3 / 5)
    blank = spark.createDataFrame([("  ",)], "t string").select(X.text_quality(F.col("t")).alias("s")).first()["s"]
    assert blank == 0


def test_month_names_are_those_of_the_graphs(spark):
    """The selection of features takes them from the orders alone."""
    from edgeloom.catalog import corpus as C

    d = "/root/testdata/sf0.001"
    nodes, _ = C.month_graphs(spark, d)
    assert {r[0] for r in C.month_ids(spark, d).collect()} == {r[0] for r in nodes.select("graph_id").distinct().collect()}


def test_bootstrap_sums_equal_the_drawn_rows(spark, monkeypatch):
    """Blocks of 8 rows, 16 draws at once; no draw is a row of a plan."""
    from edgeloom.functions.digests import numbered_digests
    from edgeloom.operators import statistics as B

    for name, size in (("BLOCK", 8), ("DRAWS", 16), ("SHARE", 2), ("DRAW_TASKS", 3)):
        monkeypatch.setattr(B, name, size)
    rows = spark.createDataFrame([("ab"[i % 3 == 0], i, float(i * i)) for i in range(100)] + [("c", 7, 2.0)], "g string, id int, v double")
    drawn = B.bootstrap_resample(rows, ["g"], 5, 42, ["id"]).groupBy("g", "rep").agg(
        F.sum("times").alias("drawn"), F.count("*").alias("distinct_rows"), F.sum(F.col("v") * F.col("times")).alias("total")
    )
    want = {tuple(r) for r in drawn.collect()}
    monkeypatch.setattr(B, "bootstrap_resample", None)
    assert {tuple(r) for r in B.bootstrap_sums(rows, ["g"], 5, 42, ["id"], "v").collect()} == want
    long = b"x" * 60
    for prefix in (b"42|a|1|", long):
        got = numbered_digests(prefix, 8, 101)
        assert got.tolist() == [int(hashlib.md5(prefix + str(i).encode()).hexdigest()[:15], 16) for i in range(8, 102)]
