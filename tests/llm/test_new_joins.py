import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from edgeloom.llm import centroids as C
from edgeloom.llm import setjoin as J
from edgeloom.llm.divergence import divergence
from edgeloom.llm.ngram_jaccard import LIMIT, bands, jaccard_classes, signatures
from tests.llm.helpers import docs, gibberish


def shingles(text, size=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain_classes(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = defaultdict(list)
    for i, s in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in held[x]:
                both[j] += 1
            held[x].append(i)
        for j, n in both.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None and (least[find(i)] is None or d < least[find(i)]):
            least[find(i)] = d
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def edited(rng, text, edits, tag):
    words = text.split()
    for k, at in enumerate(rng.choice(len(words), edits, replace=False)):
        words[at] = f"{tag}x{k}"
    return " ".join(words)


def key(r):
    return tuple((x is None, x) for x in r)


def test_jaccard_classes_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = [None, "", " \n", "one", "ONE", "one two three", "one two\tthree", "Ü a b c", "ü a b c"]
    for n in (5, 7, 8, 12, 20, 50, 130, 400):
        for k in range(6):
            base = gibberish(rng, n)
            texts += [base] + [edited(rng, base, e, f"n{n}k{k}e{e}") for e in range(1, max(2, n // 20))]
    star = gibberish(rng, 260)  # copies at the threshold of one original, not of each other
    texts += [edited(rng, star, 4, f"s{i}") for i in range(120)] + [star]
    line = gibberish(rng, 60)  # mostly one passage, but not similar
    texts += [line + " " + gibberish(rng, 22) for _ in range(60)]
    rows = [(i if i % 37 else None, t) for i, t in enumerate(texts)] + [(3, "one"), (3, "one"), (500_000, texts[40])]
    table = docs(spark, rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "component_id")
    got = [tuple(r) for r in jaccard_classes(table).collect()]
    assert sorted(got, key=key) == sorted(plain_classes(rows), key=key)
    assert jaccard_classes(table.limit(0)).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for n in [*range(1, 60), 100, 333, 2000]:
        for _ in range(20):
            s = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            cut, new = int(rng.integers(0, n // 6 + 2)), int(rng.integers(0, n // 6 + 2))
            t = np.concatenate([s[cut:], rng.integers(0, 1 << 63, new, dtype=np.uint64)])
            s, t = np.unique(s), np.unique(t)
            both = J.in_common(s, t)
            if len(t) and LIMIT.reached(both, len(s), len(t)) and both < max(len(s), len(t)):
                owner, mark = signatures([s, t])
                assert set(mark[owner == 0].tolist()) & set(mark[owner == 1].tolist()), (n, cut, new)
                a, b = (np.frombuffer(J.sketch(x), np.uint8)[None] for x in (s, t))
                assert J.may_reach(a, b, np.array([len(s)]), np.array([len(t)]), LIMIT).all()


def test_bands_are_wide_enough():
    firsts = bands(LIMIT, 5000)[:-1]
    for a in range(1, 3000):
        b = 100 * a // 85
        assert np.searchsorted(firsts, b, side="right") - np.searchsorted(firsts, a, side="right") <= 1


def plain_divergence(rows, least=10, top=10):
    pattern = __import__("re").compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = {i: i + 32 for i in range(65, 91)}
    texts = [(lang or "", source or "", pattern.findall((text or "").translate(low))) for _, text, lang, source in rows]
    df, n, groups = defaultdict(set), defaultdict(int), {(x, s) for x, s, _ in texts}
    for i, (x, s, terms) in enumerate(texts):
        for t in terms:
            df[x, t].add(i)
            n[x, s, t] += 1
    out = []
    share = lambda count, total, v: 1 + 10**9 * (count + 2) // (total + 2 * v)
    gap = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = [t for (x, t), d in df.items() if x == lang and len(d) >= least]
        mine = [s for x, s in groups if x == lang]
        p = {s: [share(n[lang, s, t], sum(n[lang, s, u] for u in kept), len(kept)) for t in kept] for s in mine}
        every = [sum(n[lang, s, t] for s in mine) for t in kept]
        q = [share(c, sum(every), len(kept)) for c in every]
        pairs = sorted((-sum(map(gap, p[source], p[s])), s.encode()) for s in mine if s != source)
        terms = sorted((-gap(a, b), t.encode()) for a, b, t in zip(p[source], q, kept, strict=True) if a > b and n[lang, source, t])
        out += [(lang, source, "pair", s.decode(), -v, r + 1) for r, (v, s) in enumerate(pairs)]
        out += [(lang, source, "term", t.decode(), -v, r + 1) for r, (v, t) in enumerate(terms[:top])]
    return sorted(out)


def test_divergence_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    words = ["the", "The", "THE,", "foo-bar", "foo", "émile", "ÉMILE", "naïve2", "x y", "a.b.a", "123", "—", "z"]
    rows = [
        (i, " ".join(rng.choice(words, rng.integers(0, 30))), ["en", "de", None][i % 3], ["a", "b", "c", None][int(rng.integers(0, 4))])
        for i in range(150)
    ]
    rows += [(7, None, "en", "empty"), (7, "", "fr", "x"), (7, "lone", "fr", "y"), rows[0], rows[0], (None, "the the", "en", "a\tb")]
    table = docs(spark, rows).withColumnRenamed("n_chars", "term")
    got = divergence(table)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows)
    assert divergence(table.limit(0)).count() == 0


ROW = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType())])


def plain_clusters(rows):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in first[:8]]
    for turn in range(11):
        told = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in kept]
        if turn < 10:
            for j in range(len(cents)):
                mine = [v for (_, v), (_, k) in zip(kept, told, strict=True) if k == j]
                if mine:
                    cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    inertia = defaultdict(int)
    for d, j in told:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(kept, told, strict=True)]


@pytest.mark.parametrize("scale", [1.0, 3e3])
def test_clusters_equal_brute_force(spark, scale):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(150, 64)), np.round(rng.normal(size=(60, 64)))]) * scale
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    rows[3] = (3, None, None)
    rows[4] = (4, [math.nan] + [0.0] * 63, None)
    rows[5] = (5, [None] + [0.0] * 63, None)
    rows[6] = (6, [1.0] * 63, None)
    rows += [rows[20], rows[20], (20, rows[21][1], None), (None, rows[22][1], None)]
    got = [tuple(r) for r in C.cluster(spark.createDataFrame(rows, ROW)).collect()]
    assert sorted(got, key=key) == sorted(plain_clusters(rows), key=key)


def test_clusters_of_few_vectors(spark):
    assert C.cluster(spark.createDataFrame([], ROW)).count() == 0
    got = C.cluster(spark.createDataFrame([(1, [0.5] * 64, None), (2, [0.5] * 64, None)], ROW)).collect()
    assert [(r["cluster"], r["distance"]) for r in got] == [(0, 0), (0, 0)]


def test_transform_keeps_distances_and_progressive_search_is_exact():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-500, 500, (400, 64)), rng.integers(-500, 500, (8, 64))
    ta, tb = C.transform(a), C.transform(b)
    far = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert np.array_equal(((ta[:, None] - tb[None]) ** 2).sum(axis=2), 64 * far)
    assert [C.original(t.astype(object)).tolist() for t in ta[:5]] == a[:5].tolist()
    which, dist, _ = C.nearest(ta, tb)
    assert np.array_equal(which, far.argmin(axis=1)) and np.array_equal(dist, 64 * far.min(axis=1))
    near = C.transform(np.repeat(b, 50, axis=0) + rng.integers(-3, 4, (400, 64)))
    assert C.nearest(near, tb)[2] < 400 * 8 * 64 / 2  # clear cases end early
    flips = np.count_nonzero(np.diff(C.hadamard(64)[C.coarse_first(64)], axis=1), axis=1)
    assert (np.diff(flips) >= 0).all()


def test_texts_of_a_shingle_or_less():
    got = J.shingle_sets(pa.array(["", " a ", "a", "a b", "A  B", "a b c d e", "b c d e"]), 4)
    assert [len(s) for s in got] == [0, 1, 1, 1, 1, 2, 1]
    assert got[1] == got[2] and got[3] == got[4] and got[6][0] in got[5]


def test_workers_take_texts_in_small_parts():
    """Long batches are cut by bytes of text; no row is lost and a longer text stands alone."""
    from edgeloom.llm.common import small_batches

    texts = ["a" * 30, None, "b" * 500, "", "c" * 60, "d" * 30] * 3
    batch = pa.RecordBatch.from_pydict({"rid": list(range(len(texts))), "text": texts})
    got = list(small_batches(iter([batch, batch.slice(0, 0)]), "text", 100))
    assert [r for b in got for r in b.column(0).to_pylist()] == list(range(len(texts)))
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= 100 for b in got)
    assert len(got) >= 6
