"""SimHash near-duplicates found through a vantage-point tree.

A fingerprint is the bitwise majority of its shingles' hashes. A tree built on
a sample of the distinct fingerprints cuts Hamming space into shards: each node
splits at the median distance to a vantage point. A fingerprint lives in one
shard and visits those later ones whose region its ball of the search radius
can reach (triangle bound), so every close pair meets exactly once. A shard is
searched by the same rule down to small blocks and returns a spanning set of
links, never all pairs; alternating star rounds join the shards' components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import Scratch, column_array, query, read, text_or_empty

RADIUS = 2
#: Distinct fingerprints a shard is meant to hold, its visitors aside.
SHARD = 4096
#: Fingerprints the tree is built on, picked by hash; fewer than 16 a shard end the splitting.
SAMPLE = 65_536
#: Distances computed at once.
BLOCK = 1 << 20
ROUNDS = 60

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
FOLD = bytes.maketrans(UPPER, LOWER)


def shingle_hashes(text: str, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a shorter text is one shingle, none has none."""
    from xxhash import xxh64_intdigest as digest

    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(line, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return np.array(
        [digest(line[a:b], seed) for a, b in zip((ends - lengths).tolist(), ends[size - 1 :].tolist(), strict=False)], np.uint64
    )


def majority(hashes: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Fingerprint of all ``hashes``, or of each run beginning at ``starts``."""
    starts = np.zeros(1, np.int64) if starts is None else starts
    if not len(hashes):
        return np.zeros(1, np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    sizes = np.diff(starts, append=len(hashes))
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def build_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a full tree in heap order; node 0 is unused.

    Of a few candidates the one whose distances spread most becomes the vantage
    point. A node without points keeps everything inside.
    """
    vantage = np.zeros(1 << depth, np.uint64)
    radius = np.full(1 << depth, 64, np.int64)
    parts = {1: np.sort(sample)}
    for node in range(1, 1 << depth):
        own = parts.pop(node, sample[:0])
        if len(own) > 1:
            tries = own[:: max(1, len(own) // 8)][:8]
            far = np.bitwise_count(tries[:, None] ^ own[None, :]).astype(np.int64)
            best = int(far.var(axis=1).argmax())
            vantage[node], radius[node] = tries[best], int(np.median(far[best]))
            inside = far[best] <= radius[node]
            parts[2 * node], parts[2 * node + 1] = own[inside], own[~inside]
    return vantage, radius


def route(points: np.ndarray, vantage: np.ndarray, radius: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, shard, at_home)``: the shard of each point and the later ones its ball reaches."""
    row, node, home = np.arange(len(points)), np.ones(len(points), np.int64), np.ones(len(points), bool)
    leaves = len(vantage)
    while leaves > 1 and len(node) and node[0] < leaves:
        far = np.bitwise_count(points[row] ^ vantage[node]).astype(np.int64)
        inside = far <= radius[node]
        to_in, to_out = far - reach <= radius[node], far + reach > radius[node]
        row = np.concatenate([row[to_in], row[to_out]])
        home = np.concatenate([(home & inside)[to_in], (home & ~inside)[to_out]])
        node = np.concatenate([2 * node[to_in], 2 * node[to_out] + 1])
    own = np.zeros(len(points), np.int64)
    own[row[home]] = node[home]
    later = node >= own[row]
    return row[later], node[later] - leaves, home[later]


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of ``a[i]`` and ``b[i]``; a class is labelled by its smallest member."""
    while len(a):
        x, y = labels[a], labels[b]
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]


def search(points: np.ndarray, own: np.ndarray, guests: np.ndarray, reach: int, labels: np.ndarray) -> None:
    """Merge the classes of all pairs within ``reach``, one of them in ``own``, the other anywhere."""
    todo = [(own, guests)]
    while todo:
        own, guests = todo.pop()
        everyone = np.concatenate([own, guests])
        if not len(own):
            continue
        if len(own) > 256:
            tries = points[own[:: max(1, len(own) // 4)][:4]]
            spread = np.bitwise_count(tries[:, None] ^ points[own][None, :]).astype(np.int64)
            best = int(spread.var(axis=1).argmax())
            radius = int(np.median(spread[best]))
            far = np.bitwise_count(points[everyone] ^ tries[best]).astype(np.int64)
            n = len(own)
            inside = far[:n] <= radius
            near_in, near_out = far - reach <= radius, far + reach > radius
            guests_in = guests[near_in[n:]]
            guests_out = np.concatenate([own[inside & near_out[:n]], guests[near_out[n:]]])
            grown = len(guests_in) + len(guests_out) + n
            if inside.any() and not inside.all() and grown < 1.7 * len(everyone):
                todo += [(own[inside], guests_in), (own[~inside], guests_out)]
                continue
            if reach == 2:
                by_shared_neighbour(points, everyone, labels)
                continue
        step = max(1, BLOCK // len(everyone))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            i, j = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[everyone][None, :]) <= reach)
            merge(labels, some[i], everyone[j])


def by_shared_neighbour(points: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
    """Classes of a ball too dense to prune, exactly and without pairs.

    Two fingerprints differ in at most two bits if and only if a flip of at
    most one bit of each gives the same value.
    """
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    passes = 1 + 65 * len(rows) // (1 << 22)
    for turn in range(passes):
        values, owners = [], []
        for at in range(0, len(rows), 16_384):
            some = rows[at : at + 16_384]
            v = (points[some][:, None] ^ flips[None, :]).ravel()
            keep = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(passes) == np.uint64(turn)
            values.append(v[keep])
            owners.append(np.repeat(some, 65)[keep])
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        same = np.flatnonzero(value[1:] == value[:-1])
        merge(labels, owner[same], owner[same + 1])


def shard_links(table: pa.Table, reach: int) -> pa.Table:
    """``(u, v)``: every fingerprint of a shard with a smaller one of its class."""
    fp = table.column("fp").to_numpy()
    order = np.argsort(fp, kind="stable")
    fp, home = fp[order], table.column("home").to_numpy()[order]
    labels = np.arange(len(fp))
    search(fp.view(np.uint64), np.flatnonzero(home), np.flatnonzero(~home), reach, labels)
    linked = np.flatnonzero(labels != np.arange(len(fp)))
    return pa.table({"u": fp[linked], "v": fp[labels[linked]]})


def close_links(points: DataFrame, scratch: Scratch, reach: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links ``(u, v)`` whose components are those of all pairs of distinct ``fp`` within ``reach``.

    ``points`` is a kept table of distinct ``fp``. Only a hashed sample of at
    most about ``SAMPLE`` fingerprints comes to the driver, for the tree.
    """
    total = points.count()
    # Each half of a node's sample should still say where the median is.
    depth = min(max(0, int(np.ceil(np.log2(max(1, total) / shard)))), int(np.log2(SAMPLE)) - 4)
    every = max(1, total // SAMPLE)
    sample = (
        points.filter(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
        if depth
        else np.zeros(0, np.uint64)
    )
    vantage, radius = build_tree(sample, depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            row, leaf, home = route(fp.view(np.uint64), vantage, radius, reach)
            for at in range(0, len(row), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_pydict({"shard": leaf[part], "fp": fp[row[part]], "home": home[part]})

    return (
        points.select("fp")
        .mapInArrow(deal, "shard long, fp long, home boolean")
        .groupBy("shard")
        .applyInArrow(lambda table: shard_links(table, reach), "u long, v long")
    )


def settled(star: DataFrame) -> bool:
    """Every node points at one root and no root points anywhere."""
    roles = star.select(F.expr("inline(array(struct(u AS x, 1 AS out, 0 AS root), struct(v AS x, 0 AS out, 1 AS root)))"))
    each = roles.groupBy("x").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
    return each.filter("out > 1 OR out = 1 AND root = 1").count() == 0


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(u, v)``: every node but the smallest of its component, with that smallest one.

    Large-star and small-star in turn. Minima are written tables, so that both
    sides of each join are dealt afresh and a hub's rows can be split.
    """
    star = scratch.keep(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    for _ in range(ROUNDS):
        if settled(star):
            return star
        both = star.select(F.expr("inline(array(struct(u AS x, v AS y), struct(v AS x, u AS y)))"))
        low = scratch.keep(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")))
        large = scratch.keep(both.filter("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        # A node has as many smaller neighbours as shards or classes it is in: no hub on this side.
        small = scratch.keep(
            large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
            .select(F.expr("inline(array(struct(v AS u, m AS v), struct(u AS u, m AS v)))"))
            .filter("u <> v")
            .distinct()
        )
        scratch.drop(star, low, large)
        star = small
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row; a text without a word has fingerprint 0."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [majority(shingle_hashes(t, size)) for t in column_array(batch, "text").to_pylist()]
            fp = np.concatenate([*fp, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def simhash_classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3, reach: int = RADIUS
) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs``.

    Rows whose fingerprints differ in at most ``reach`` bits are linked;
    ``component_id`` is the smallest doc_id reachable. Null and empty texts have
    fingerprint 0 and are linked like any other. Rows with a null doc_id are
    classed too but lend no id; a class of such rows only has a null id. Equal
    rows stay separate rows.
    """
    scratch = Scratch(docs.sparkSession)
    marks = scratch.keep(fingerprints(docs, text, doc_id, size))
    nodes = scratch.keep(marks.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = scratch.keep(close_links(nodes, scratch, reach))
    star = components(links, scratch)
    rooted = scratch.keep(
        nodes.join(star.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        )
    )
    smallest = scratch.keep(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = scratch.keep(rooted.join(smallest, "root").select("fp", "component_id"))
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


@query("op1_simhash_components")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: three-word shingles, at most two differing bits."""
    found = simhash_classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
