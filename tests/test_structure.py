"""Hand-made graphs with values worked out from the definitions."""

import hashlib
import math
import random

import numpy as np
import pytest

from edgeloom.operators import invariants as I
from edgeloom.operators import structure as S
from edgeloom.operators import triangles as T
from edgeloom.operators.components import connected_components
from edgeloom.operators.splits import kg_split, mask_split
from edgeloom.sources.kg import integrity_violations, require_integrity

K = ["domain"]


def kg(spark, graphs):
    """``{name: (entities [(id, type)], edges [(src, dst, et)])}`` → (entities, edges)."""
    ents = [(g, i, t) for g, (nodes, _) in graphs.items() for i, t in nodes]
    links = [(g, *e) for g, (_, edges) in graphs.items() for e in edges]
    return (
        spark.createDataFrame(ents, "domain string, id string, entity_type string"),
        spark.createDataFrame(links, "domain string, src string, dst string, et string"),
    )


def plain(names, kind="concept"):
    return [(n, kind) for n in names]


GRAPHS = {
    "empty": (plain("ab"), []),
    "tiny": (plain("abc"), [("a", "b", "depends_on"), ("b", "c", "depends_on")]),
    "triangle": (plain("abc"), [("a", "b", "depends_on"), ("b", "c", "depends_on"), ("a", "c", "depends_on")]),
    "mixed": (plain("abcd"), [("a", "b", "depends_on"), ("b", "c", "derives"), ("c", "d", "explains"), ("a", "d", "maps_to")]),
    "contradicts": (plain("abcde"), [("a", "b", "contradicts"), ("b", "c", "contradicts"), ("c", "d", "contradicts"), ("d", "e", "contradicts")]),
    "self_loop": (plain("ab"), [("a", "a", "derives"), ("a", "b", "derives")]),
    "parallel": (plain("ab"), [("a", "b", "derives"), ("a", "b", "derives"), ("a", "b", "explains")]),
}


@pytest.fixture(scope="module")
def table(spark):
    entities, edges = kg(spark, GRAPHS)
    return {r["domain"]: r for r in S.components_table(edges, entities, K).collect()}


def test_component_values(table):
    assert table["empty"]["compressibility"] == 1 and table["empty"]["symmetry"] == 1
    assert table["tiny"]["compressibility"] == pytest.approx(1.0)
    assert table["triangle"]["compressibility"] == pytest.approx(5 / 6)
    assert table["triangle"]["coherence"] == pytest.approx(1.0)
    assert table["mixed"]["compressibility"] == pytest.approx((1 - 2 / math.log2(7) + 3 / 4) / 2)
    assert table["contradicts"]["coherence"] == pytest.approx(0.5)


def test_self_loop_triples_count(spark):
    _, edges = kg(spark, {"g": GRAPHS["self_loop"]})
    row = T.directed_triangle_counts(edges, K).first()
    assert (row["n_triangles"], row["n_coherent"]) == (1, 1)
    assert [(r["a"], r["b"], r["c"]) for r in T.directed_triangles(edges, K).collect()] == [("a", "a", "b")]


def brute_triples(edges):
    masks = {}
    for s, d, et in edges:
        masks.setdefault((s, d), set()).add(et)
    total = good = 0
    for (a, b), ab in masks.items():
        for (b2, c), bc in masks.items():
            if b2 == b and c != a and (a, c) in masks:
                total += 1
                good += bool(masks[a, c] & (ab | bc))
    return total, good


def test_triangles_match_brute_force_with_hub(spark):
    rng = random.Random(3)
    types = ["derives", "explains", "contradicts"]
    nodes = [f"n{i}" for i in range(14)]
    edges = [(rng.choice(nodes), rng.choice(nodes), rng.choice(types)) for _ in range(90)]
    edges += [("n0", n, "derives") for n in nodes] + [(n, "n1", "maps_to") for n in nodes]
    _, df = kg(spark, {"g": (plain(nodes), edges)})
    row = T.directed_triangle_counts(df, K).first()
    want = brute_triples(edges)
    assert (row["n_triangles"], row["n_coherent"]) == want
    listed = T.directed_triangles(df, K).collect()
    assert len(listed) == want[0] and sum(r["coherent"] for r in listed) == want[1]


def test_components_on_long_path_and_isolated(spark):
    nodes = [f"v{i:03d}" for i in range(60)] + ["alone"]
    edges = [(f"v{i:03d}", f"v{i + 1:03d}", "derives") for i in range(59) if i != 30]
    ents, df = kg(spark, {"g": (plain(nodes), edges)})
    got = {r["id"]: r["component"] for r in connected_components(ents, df, K).collect()}
    assert got["v030"] == "v000" and got["v059"] == "v031" and got["alone"] == "alone"


def test_profile_symmetry_single_source_per_type(spark):
    ents = [("a", "x"), ("b", "y"), ("c", "z")]
    entities, edges = kg(spark, {"g": (ents, [("a", "b", "derives"), ("b", "c", "explains"), ("c", "a", "maps_to")])})
    assert S.symmetry(edges, entities, K).first()["symmetry"] == pytest.approx(1.0)


def test_dominance(spark):
    nodes = [f"e{i}" for i in range(10)]
    edges = [(f"e{i}", f"e{i + 1}", "depends_on") for i in range(9)] + [("e0", "e5", "derives")]
    entities, df = kg(spark, {"g": (plain(nodes), edges)})
    row = S.frequency_dominance(df, entities, K).first()
    assert row["p_max"] == pytest.approx(0.9) and row["skew"] == pytest.approx(9)
    assert row["sparsity"] == pytest.approx(1 - 10 / 90)


def test_integrity(spark):
    entities, edges = kg(spark, {"g": ([("a", "x"), ("a", "x")], [("a", "b", "derives"), ("a", "a", "odd")])})
    kinds = {r["kind"] for r in integrity_violations(entities, edges).collect()}
    assert kinds == {"duplicate_id", "dangling_target", "unknown_edge_type"}
    with pytest.raises(ValueError):
        require_integrity(entities, edges)


def test_tasks_contract_their_edges_and_keep_the_components(spark, monkeypatch):
    """Two graphs with the same node names; chunks of 16 edges, so that a task contracts many times."""
    from edgeloom.operators import components as C

    monkeypatch.setattr(C, "CHUNK_EDGES", 16)
    rng = random.Random(3)
    rows = [(g, f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for g in ("x", "y") for _ in range(45)]
    rows += [("x", "n00", f"n{i:02d}") for i in range(20, 50)] * 20
    edges = spark.createDataFrame(rows, "domain string, u string, v string")
    small = C.contracted(edges.coalesce(1), K)
    assert small.count() < 120
    root = {(g, f"n{i:02d}"): (g, f"n{i:02d}") for g in ("x", "y") for i in range(60)}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for g, a, b in rows:
        a, b = find((g, a)), find((g, b))
        root[max(a, b)] = min(a, b)
    want = {(*a, find(a)[1]) for a in root if find(a) != a}
    assert {tuple(r) for r in C.component_stars(edges, K, "u", "v").collect()} == want


def test_triangles_in_many_small_cells(spark, monkeypatch):
    """Graphs above one cell are coloured: same counts and rows, and no cell beyond its bound by much."""
    monkeypatch.setattr(T, "CELL_PAIRS", 40)
    rng = random.Random(8)
    types = ["derives", "explains", "contradicts"]
    nodes = [f"n{i}" for i in range(40)]
    big = [(rng.choice(nodes), rng.choice(nodes), rng.choice(types)) for _ in range(400)]
    mid = [(rng.choice(nodes[:12]), rng.choice(nodes[:12]), rng.choice(types)) for _ in range(90)]
    _, df = kg(spark, {"big": (plain(nodes), big), "mid": (plain(nodes[:12]), mid), "tiny": GRAPHS["triangle"]})
    got = {r["domain"]: (r["n_triangles"], r["n_coherent"]) for r in T.directed_triangle_counts(df, K).collect()}
    assert got["big"] == brute_triples(big) and got["mid"] == brute_triples(mid) and got["tiny"][0] > 0
    rows = [r for r in T.directed_triangles(df, K).collect() if r["domain"] == "big"]
    assert len({(r["a"], r["b"], r["c"]) for r in rows}) == len(rows) == got["big"][0]
    cells = T._dealt(T.node_pairs(df, K), K).groupBy("domain", "cell").count().collect()
    assert len(cells) > 20 and max(r["count"] for r in cells) <= 80


def test_node_counts_in_cells_count_copies_once(spark, monkeypatch):
    monkeypatch.setattr(T, "CELL_PAIRS", 30)
    rng = random.Random(5)
    edges = [("g", rng.randrange(25), rng.randrange(25)) for _ in range(500)]
    df = spark.createDataFrame(edges, "graph_id string, u long, v long")
    lonely = spark.createDataFrame([("g", 99), ("g", 99), ("h", 1)], "graph_id string, v long")
    near = {}
    for _, u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    want = {
        ("g", u): (len(n), sum(1 for a in n for b in n if a < b and b in near[a])) for u, n in near.items()
    } | {("g", 99): (0, 0), ("h", 1): (0, 0)}
    feats = I.node_features(lonely, df)
    assert {(r["graph_id"], r["v"]): (r["deg"], r["t"]) for r in feats.collect()} == want
    x = [len(near[u]) for u in near for _ in near[u]]
    y = [len(near[v]) for u in near for v in near[u]]
    rows = {r["graph_id"]: r["degree_assortativity"] for r in I.degree_assortativity(feats, I.as_pairs(df)).collect()}
    assert rows["g"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and rows["h"] == 0


def test_splits_sort_only_the_edges_at_their_cuts(spark):
    rng = random.Random(2)
    edges = {"big": [(f"a{rng.randrange(60)}", f"b{rng.randrange(60)}", "derives") for _ in range(5000)], "one": [("a", "b", "derives")]}
    _, df = kg(spark, {g: (plain(["x"]), e) for g, e in edges.items()})
    four, two = kg_split(df, K), mask_split(df, K)
    for g, rows in edges.items():
        seen, hashed = {}, []
        for s, d, et in rows:
            seen[s, d] = seen.get((s, d), 0) + 1
            text = "|".join(["42", g, s, d, et, str(seen[s, d])])
            hashed.append((hashlib.md5(text.encode()).hexdigest(), s, d, seen[s, d]))
        order = [r[1:] for r in sorted(hashed)]
        n = len(order)
        hidden = max(1, round(n * 0.1))
        tenth = round((n - hidden) * 0.1)
        places = [hidden, n - hidden - 2 * tenth, tenth, tenth]
        want = dict(zip(order, [x for x, k in zip(("hidden", "train", "val", "test"), places) for _ in range(k)]))
        got = {(r["src"], r["dst"], r["copy"]): r["split"] for r in four.filter(f"domain = '{g}'").collect()}
        assert got == want
        tests = {(r["src"], r["dst"], r["copy"]) for r in two.filter(f"domain = '{g}' AND split = 'test'").collect()}
        assert tests == set(order[: max(1, n // 5)])
    assert "Window" not in two._jdf.queryExecution().executedPlan().toString()


def test_only_centres_go_into_the_rounds(spark, monkeypatch):
    from edgeloom.operators import components as C

    rows = [("g", n, 0) for n in range(1, 500)] + [("h", 7, 3), ("h", 3, 9), ("h", 20, 21)]
    edges = spark.createDataFrame(rows, "domain string, src long, dst long").repartition(6)
    seen, plain = [], C._is_star
    monkeypatch.setattr(C, "_is_star", lambda star, keys: seen.append(star.count()) or plain(star, keys))
    want = {("g", n, 0) for n in range(1, 500)} | {("h", 7, 3), ("h", 9, 3), ("h", 21, 20)}
    assert {tuple(r) for r in C.component_stars(edges, K).collect()} == want
    assert seen[0] <= 3
    assert {tuple(r) for r in C.forest_sizes(edges, K).collect()} == {("g", 499), ("h", 3)}


def test_parts_before_and_after_equal_two_whole_tables(spark):
    kinds = ["derives", "explains", "contradicts", "maps_to"]
    rows = [("g", i % 13, i * 5 % 17, kinds[i % 4]) for i in range(60)] + [("g", 40, 41, "derives"), ("g", 3, 3, "maps_to")]
    more = [("g", 41, 2, "derives"), ("g", 2, 40, "explains"), ("g", 4, 11, "contradicts"), ("g", 5, 5, "derives"), ("g", 50, 51, "maps_to")]
    schema = "domain string, src long, dst long, et string"
    edges, added = spark.createDataFrame(rows, schema), spark.createDataFrame(more, schema)
    nodes = spark.createDataFrame([("g", n, "ab"[n % 2]) for n in range(60)], "domain string, id long, entity_type string")
    got = [r.collect()[0] for r in S.components_before_after(edges, added, nodes, K)]
    want = [S.components_table(e, nodes, K).collect()[0] for e in (edges, edges.unionByName(added))]
    for a, b in zip(got, want):
        assert a.asDict() == pytest.approx(b.asDict())


def test_numbered_nodes_are_written_as_their_texts(spark):
    from edgeloom.catalog.derive import kind_of, node_text, number_of

    texts = ["region:0", "order:149999", "new:12", "part:9007199254740993", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", number_of("t").alias("n"))
    for r in rows.filter("t IS NOT NULL").select("t", node_text("n").alias("u"), kind_of("n").alias("k")).collect():
        assert r.u == r.t and r.k == r.t.split(":")[0]
    assert rows.filter("t IS NULL").first().n is None


def test_largest_members_keep_copies_and_graphs_without_edges(spark, monkeypatch):
    from pyspark.sql import functions as F

    from edgeloom.operators import invariants as I

    edges = [("g", "a", "b")] * 3 + [("g", "b", "a"), ("g", "c", "d"), ("g", "d", "e"), ("h", "x", "y"), ("h", "p", "q"), ("g", "e", None)]
    lone = [("g", "a"), ("g", "z"), ("h", "o"), ("i", "t"), ("i", "s"), ("i", "t")]
    edges = spark.createDataFrame(edges, "graph_id string, u string, v string")
    lone = spark.createDataFrame(lone, "graph_id string, v string")
    monkeypatch.setattr(I, "connected_components", None)
    got = sorted(tuple(r) for r in I.largest_members(lone, edges, F.col).collect())
    assert got == [("g", "c"), ("g", "d"), ("g", "e"), ("h", "p"), ("h", "q"), ("i", "s")]
