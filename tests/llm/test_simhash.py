import numpy as np
import xxhash

from edgeloom.llm import simhash as S
from edgeloom.llm.common import QUERIES
from edgeloom.llm.near_dedup import near_dedup_stage
from tests.llm.helpers import docs, folder, gibberish


def plain_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) <= size else [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def plain_components(items, reach=2):
    """Smallest reachable id by search over all pairs."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i] ^ items[j]).bit_count() <= reach:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(items))]


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = [gibberish(rng, int(rng.integers(1, 300))) for _ in range(60)]
    texts = base + base[:7] + [b.upper() for b in base[:5]] + [b.replace(" ", "\n\t", 3) for b in base[5:9]]
    for b in base[10:30]:
        w = b.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \n", "é\xa0ü z", "one", "one two", "one two three", "x" * 50_000]
    table = docs(spark, list(enumerate(texts))[::-1])
    got = {r["doc_id"]: r for r in QUERIES["op1_simhash_components"](spark, folder(tmp_path, documents=table)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == plain_components(prints)


def test_ids_null_rows_repeated_extra_columns_and_empty_table(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, None), (None, "only null id here")]
    table = docs(spark, rows).withColumnRenamed("lang", "fp").withColumnRenamed("source", "component_id")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in S.simhash_classes(table).collect())
    assert got == [(-1, -1), (-1, 7), (7, 7), (7, 7), (9, 9)]
    assert S.simhash_classes(table.limit(0)).count() == 0


def test_shards_find_every_pair_that_brute_force_finds():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for i in range(600):  # near pairs, and one dense ball
        flips = rng.choice(64, rng.integers(0, 4), replace=False)
        change = np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if len(flips) else np.uint64(0)
        points[i] = points[rng.integers(0, 3000)] ^ change if i % 2 else points[2999] ^ change
    points = np.unique(points.view(np.int64)).view(np.uint64)
    points = points[np.argsort(points.view(np.int64))]
    want = np.arange(len(points))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    S.merge(want, i, j)
    vantage, radius = S.build_tree(points[::5].copy(), 4)
    row, shard, home = S.route(points, vantage, radius, 2)
    assert np.array_equal(np.sort(row[home]), np.arange(len(points)))
    got = np.arange(len(points))
    for s in range(16):
        own, guests = row[(shard == s) & home], row[(shard == s) & ~home]
        S.search(points, own, guests, 2, got)
    assert np.array_equal(got, want)
    dense = np.arange(len(points))
    S.by_shared_neighbour(points, np.arange(len(points)), dense)
    assert np.array_equal(dense, want)


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stage_keeps_one_of_each_group_and_clean_documents(spark):
    rng = np.random.default_rng(5)
    line = gibberish(rng, 40)  # a passage that unrelated texts share
    base = [gibberish(rng, int(rng.integers(80, 400))) for _ in range(40)]
    rows = [(i, t if i % 4 else line + "\n" + t) for i, t in enumerate(base)]
    copies = []
    for i in range(20):
        words = rows[i][1].split()
        for at in rng.choice(len(words), max(1, len(words) // 80), replace=False):
            words[at] = "edited"
        copies.append((100 + i, " ".join(words)))
    exact = [(200 + i, rows[0][1]) for i in range(30)]
    blank = [(300, None), (301, ""), (302, " ")]
    table = docs(spark, rows + copies + exact + blank + [(5, rows[5][1])])
    kept = sorted(r["doc_id"] for r in near_dedup_stage(spark, table, "").collect())
    near = [i for i, t in copies if len(shingles(t) & shingles(rows[i - 100][1])) >= 0.8 * len(shingles(t) | shingles(rows[i - 100][1]))]
    assert len(near) >= 15
    assert set(range(40)) <= set(kept)
    assert kept.count(5) == 1
    assert not set(kept) & set(range(200, 230))
    assert len(set(kept) & set(near)) <= len(near) // 10
    assert set(kept) & {300, 301, 302} == {300}  # texts without a word are copies of each other
    assert near_dedup_stage(spark, table.limit(0), "").count() == 0
    assert near_dedup_stage(spark, table, "").columns == table.columns


def classes(texts):
    """Exact components of all pairs with 0.8 of their shingles in common."""
    sets = [shingles(t) for t in texts]
    held, root = {}, list(range(len(texts)))
    for i, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        both = {}
        for x in s:
            for j in held[x]:
                both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if j < i and 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in range(len(texts)) if find(i) == i}


def kept_of(spark, texts):
    return {r["doc_id"] for r in near_dedup_stage(spark, docs(spark, list(enumerate(texts))), "").collect()}


def test_copies_that_are_similar_to_their_original_only_are_found(spark):
    rng = np.random.default_rng(11)
    words = gibberish(rng, 300).split()
    star = []
    for i in range(1500):  # 0.85 similar to the original, about 0.73 to each other
        own = list(words)
        for k, at in enumerate(rng.choice(60, 5, replace=False)):
            own[5 * at] = f"edit{i}x{k}"
        star.append(" ".join(own))
    line = gibberish(rng, 60)  # texts that are mostly one passage, but not similar
    alike = [line + " " + gibberish(rng, 25) for _ in range(300)]
    texts = star[:700] + [" ".join(words)] + star[700:] + alike
    want = classes(texts)
    assert len(want) == 301
    assert kept_of(spark, texts) == want


def edited(rng, text, edits, tag):
    words = text.split()
    for k, at in enumerate(rng.choice(len(words), edits, replace=False)):
        words[at] = f"{tag}x{k}"
    return " ".join(words)


def test_scattered_edits_and_repeated_passages(spark):
    rng = np.random.default_rng(21)
    passage = gibberish(rng, 20)
    texts = [gibberish(rng, 300) + (" " + passage) * 6 for _ in range(80)]
    texts += [edited(rng, t, int(rng.integers(5, 9)), f"e{i}") for i, t in enumerate(texts)]
    want = classes(texts)
    assert 80 <= len(want) < 160
    assert kept_of(spark, texts) == want


def test_pairs_of_110_to_135_words(spark):
    rng = np.random.default_rng(22)
    texts = [gibberish(rng, n) for n in range(110, 136) for _ in range(3)]
    texts += [" ".join(w[:k] + w[k + 2 :]) for w in (t.split() for t in texts) for k in [int(rng.integers(0, 100))]]
    want = classes(texts)
    assert len(want) == len(texts) // 2
    assert kept_of(spark, texts) == want
