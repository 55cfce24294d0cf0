import math

import numpy as np
from pyspark.sql import types as T

from edgeloom.llm.ann import block_search, rounded, tile
from edgeloom.llm.knn_join import knn_join

ROW = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("rank", T.StringType()),
        T.StructField("score", T.StringType()),
    ]
)


def vectors():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(260, 8)), rng.normal(size=(6, 8)).repeat(20, axis=0) + rng.normal(size=(120, 8)) * 0.01])
    x[50:60] = x[0]  # ties
    rows = [(i, v.tolist(), "r", "s") for i, v in enumerate(x)]
    rows[5] = (5, None, None, None)
    rows[6] = (6, [1.0, None] + [0.0] * 6, None, None)
    rows[7] = (7, [math.nan] + [0.0] * 7, None, None)
    rows[8] = (8, [math.inf] + [0.0] * 7, None, None)
    rows[9] = (9, [], None, None)
    rows[10] = (10, [1.0, 2.0], None, None)
    rows[150] = (150, [0.0] * 8, None, None)
    rows += [(None, [1.0] * 8, None, None), rows[20], rows[100]]
    return rows


def usable(rows, zero=True):
    out = {}
    for i, v, *_ in rows:
        if i is not None and v and len(v) == 8 and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v)):
            out[i] = v
    return out


def brute(rows, score, zero):
    have = usable(rows, zero)
    out = []
    for q in sorted(have):
        if q % 50 == 0:
            best = sorted(((-score(have[q], v), i) for i, v in have.items() if i != q))[:5]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def floor_product(a, b):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=True))


def cosine(a, b):
    dot = lambda u, v: sum((x * y for x, y in zip(u, v, strict=True)), 0.0)
    return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))


def test_voronoi_join_equals_brute_force(spark):
    rows = vectors()
    got = sorted(tuple(r) for r in knn_join(spark.createDataFrame(rows, ROW)).collect())
    assert got == brute(rows, floor_product, True)


def test_scores_beyond_doubles_are_exact_and_few(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=8) * 1e6).tolist(), None, None) for i in range(120)]
    rows[60] = (60, rows[59][1], None, None)
    got = sorted(tuple(r) for r in knn_join(spark.createDataFrame(rows, ROW)).collect())
    assert got == brute(rows, floor_product, True)


def test_block_join_equals_brute_force(spark):
    rows = vectors()
    got = sorted(tuple(r) for r in block_search(spark.createDataFrame(rows, ROW)).collect())
    want = brute(rows, cosine, False)
    assert [g[:3] for g in got] == [w[:3] for w in want]  # recall 1
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-15)


def test_few_rows_and_empty_tables(spark):
    for search in (knn_join, block_search):
        assert search(spark.createDataFrame([], ROW)).count() == 0
        assert search(spark.createDataFrame([(50, [1.0], None, None)], ROW)).count() == 0
        got = search(spark.createDataFrame([(0, [1.0], None, None), (3, [2.0], None, None), (2, [2.0], None, None)], ROW)).collect()
        assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (2, 3)]


def test_eight_bit_products_stay_within_their_bounds():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(200, 64)), rng.normal(size=(300, 64)) ** 5
    (qa, sa, ea), (qb, sb, eb) = rounded(a), rounded(b)
    true = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    near = tile(qa, qb).astype(float) * sa[:, None] * sb[None, :]
    assert (np.abs(true - near) <= ea[:, None] + eb[None, :] * (1 + ea[:, None])).all()
