"""Exact Jaccard join of n-gram sets by PartEnum signatures.

Sizes are cut into bands as wide as the threshold allows, so similar sets lie in
one band or in neighbouring ones. For such a pair of bands the sets differ in at
most k elements. The feature domain is dealt by hash to first-level partitions,
more than k // 2 of them, so in one at least the sets differ in at most one
element; each is dealt again to PARTS second-level partitions, of which all but
one then agree. Every choice of all but one is enumerated, and the elements of a
set in it are one signature: similar sets share at least one.

A signature without elements says nothing. A band therefore has a few spare
partitions, and a set with more empty signatures than those deals its elements
once more by another hash. Of two similar sets, the first that is content with
its dealing has shared a signature with elements: no list of empty signatures
is needed, and no pair is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import Scratch, query, read
from edgeloom.llm.setjoin import ODD, Similarity, emit, joined, mix64, nodes_of, sets_of, split_off

WORDS = 4
LIMIT = Similarity(85, 100)
#: Second-level partitions; a signature is all of them but one. Three make signatures a third
#: longer, hence fewer chance meetings, but half as many again to shuffle.
PARTS = 2
#: Dealings tried before empty signatures are given out after all.
DEALINGS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bands(limit: Similarity, largest: int) -> np.ndarray:
    """First sizes of the bands up to ``largest``; similar sets are at most one band apart."""
    firsts = [1]
    while firsts[-1] <= largest:
        firsts.append(limit.den * firsts[-1] // limit.num + 1)
    return np.array([*firsts, limit.den * firsts[-1] // limit.num + 1, 1 << 62], np.int64)


def partitions(limit: Similarity, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per band, for sets of it and the band below: first-level partitions (0: only equal sets are similar) and spare ones."""
    most = firsts[1:-1] - 1
    least = np.concatenate([firsts[:1], firsts[: len(most) - 1]])
    k = (limit.den - limit.num) * 2 * most // (limit.den + limit.num)
    count = k // 2 + 1
    empty = count * PARTS * np.exp(-(PARTS - 1) * least / (PARTS * count))
    spare = np.where(empty < 0.02, 0, np.ceil(empty + 2 * np.sqrt(empty))).astype(np.int64)
    return np.where(k > 0, count + spare, 0), spare


def signatures(sets: list[np.ndarray], limit: Similarity = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, signature)`` of all sets, given as arrays of distinct 64-bit hashes."""
    size = np.array([len(s) for s in sets], np.int64)
    firsts = bands(limit, int(size.max(initial=0)))
    counts, spares = partitions(limit, firsts)
    band = np.searchsorted(firsts, size, side="right") - 1
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for up in (0, 1):
        slot = np.maximum(band, 0) + up
        todo = np.flatnonzero((size > 0) & (counts[slot] > 0))
        for turn in range(DEALINGS):
            if not len(todo):
                break
            n, spare = counts[slot[todo]], spares[slot[todo]]
            mine = np.repeat(np.arange(len(todo)), size[todo])
            x = np.concatenate([sets[i] for i in todo.tolist()])
            dealt = mix64(x ^ mix64(np.full(1, turn + 1, np.uint64) * ODD[0]))
            base = np.cumsum(n) - n
            first = base[mine] + ((dealt >> np.uint64(32)) % n[mine].astype(np.uint64)).astype(np.int64)
            cell = PARTS * first + ((dealt & np.uint64(0xFFFFFFFF)) % np.uint64(PARTS)).astype(np.int64)
            total = np.zeros(PARTS * int(n.sum()), np.uint64)
            np.add.at(total, cell, mix64(x + ODD[1]))
            held = np.bincount(cell, minlength=len(total)).reshape(-1, PARTS)
            total = total.reshape(-1, PARTS)
            owner = np.repeat(np.arange(len(todo)), n)
            place = np.arange(len(owner)) - base[owner]
            tag = (slot[todo][owner] << 40 | place << 8 | turn << 2).astype(np.uint64)
            empty = np.zeros(len(owner), bool)
            for out in range(PARTS):
                some = held.sum(axis=1) > held[:, out]
                empty |= ~some
                give = some | (turn == DEALINGS - 1)
                mark = mix64(total.sum(axis=1) - total[:, out] + mix64((tag | np.uint64(out)) * ODD[2]))
                owners.append(todo[owner[give]])
                found.append(mark[give])
            todo = todo[np.bincount(owner, empty, minlength=len(todo)) > spare]
    return np.concatenate(owners), np.concatenate(found)


def jaccard_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, limit: Similarity = LIMIT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs``.

    Two rows are linked when the Jaccard similarity of their sets of distinct
    ``words``-word shingles reaches ``limit``; ``component_id`` is the smallest
    doc_id reachable. A text of fewer words is one shingle; a null, empty or
    blank text has an empty set and is linked with nothing: its component is its
    own doc_id. Rows with a null doc_id are joined like any other but lend no id;
    a class of such rows only has a null id. Equal rows stay separate rows.
    Other columns of ``docs`` are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(emit(docs, text, doc_id, words, lambda sets: signatures(sets, limit)))
    heads = split_off(rows, scratch)
    nodes = scratch.keep(nodes_of(heads.filter("n > 0")))
    star = joined(rows, heads, nodes, sets_of(docs, nodes, text, doc_id, words, scratch), limit, scratch)
    rooted = scratch.keep(
        nodes.join(star.select(F.col("u").alias("key"), F.col("v").alias("root")), "key", "left").select(
            "n", "d1", "d2", "least", F.coalesce("root", "key").alias("root")
        )
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(rooted.join(smallest, "root").select("n", "d1", "d2", "component_id"))
    return (
        heads.select("doc_id", "n", "d1", "d2")
        .join(named, ["n", "d1", "d2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(w) < {WORDS} THEN list_filter([array_to_string(w, ' ')], lambda x: x <> '')
    ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS x FROM w),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE {LIMIT.den} * i >= {LIMIT.num} * (x.n + y.n - i)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT r AS a, r AS b FROM w UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
m AS (SELECT a AS r, min(doc_id) AS component_id FROM c JOIN w ON w.r = c.b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM w JOIN m USING (r) LEFT JOIN n USING (r)
"""


@query("op12_ngram_jaccard_components", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents whose sets of four-word shingles have 0.85 in common."""
    return jaccard_classes(read(spark, sf_dir, "documents"))
