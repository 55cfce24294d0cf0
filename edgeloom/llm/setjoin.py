"""Components of similar shingle sets, from tokens that similar sets are sure to share.

What the Jaccard operators have in common. An operator turns each text into its
set of hashed shingles and emits tokens such that two similar sets share at
least one. Equal sets are one node. Nodes with a common token form a list; no
list is ever expanded into all its pairs unless it is short:

1. lists with the same members are one list;
2. each member is compared with its list's leader, the member with the most
   company over all lists (an original among its copies);
3. lists still in several components are compared in full: short ones by pairs,
   long ones with their leader's other lists, in cells of bounded size, first by
   sketch, and only between members of different components.

Pairs are screened first by sketches that bound their intersection from above;
only the shingle sets of texts in the pairs that are left are moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import Scratch, column_array, fresh_worker, small_batches, split_words, text_or_empty
from edgeloom.llm.simhash import components

#: Members up to which an open list is compared by pairs: a group of its own costs a
#: millisecond in a Python worker, as much as about thirty pairs.
FEW = 8
#: Texts on either side of a cell.
CELL = 2048
#: Counts of a sketch; a count of 255 stands for any larger one.
SKETCH = 256
#: Tokens a row carries; more of one text take more rows.
TOKENS_A_ROW = 100_000

ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


@dataclass(frozen=True)
class Similarity:
    """A Jaccard threshold ``num / den``, compared in whole numbers."""

    num: int
    den: int

    def reached(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (a + b - both)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Per text the sorted 64-bit hashes of its distinct shingles of ``words`` words.

    A-Z are lower-cased, words are what ASCII white space separates; a text of
    fewer words is one shingle, one without words none.
    """
    from xxhash import xxh64_intdigest

    codes, distinct, first = split_words(pc.ascii_lower(texts))
    hashes = np.fromiter((xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    real = np.fromiter((len(w) > 0 for w in distinct), bool, len(distinct))[codes] if len(distinct) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(real)])
    first = kept[first]
    word = hashes[codes[real]] if len(codes) else np.zeros(0, np.uint64)
    full = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for j in range(words):
        full += word[j : j + len(full)] * ODD[j % len(ODD)] + np.uint64(j)
    full = mix64(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for j in range(b - a):
                short = mix64(short + word[a + j : a + j + 1] * ODD[j % len(ODD)])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(s: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of SKETCH classes."""
    return np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH), 255).astype(np.uint8).tobytes()


def may_reach(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, limit: Similarity) -> np.ndarray:
    """Whether sets with these sketches (rows) can be similar: no class has more in common than its lesser count."""
    least = np.minimum(a, b)
    most = least.sum(axis=1, dtype=np.int64)
    return limit.reached(most, size_a, size_b) | (least == 255).any(axis=1)


#: Tokens ``(owner, token)`` of many sets at once.
Tokens = Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]


def emit(docs: DataFrame, text: str, doc_id: str, words: int, tokens: Tokens, marks: Callable | None = None) -> DataFrame:
    """One row a text (more when it has many tokens): ``rid, doc_id, th, n, d1, d2, mark, sketch, part, tokens``.

    ``rid`` numbers the rows of ``docs``; ``d1, d2`` digest the set, ``th`` the
    text; ``mark`` is what ``marks`` makes of a set, else 0.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    shape = f"rid long, doc_id {kind}, th long, n long, d1 long, d2 long, mark long, sketch binary, part int, tokens array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in small_batches(batches, "text"):
            sets = shingle_sets(column_array(batch, "text"), words)
            owner, token = tokens(sets)
            order = np.argsort(owner, kind="stable")
            token = token[order].view(np.int64)
            ends = np.cumsum(np.bincount(owner, minlength=len(sets)))
            head = {"n": [], "d1": [], "d2": [], "mark": []}
            for s in sets:
                head["n"].append(len(s))
                head["d1"].append(int(mix64(s).sum().view(np.int64)))
                head["d2"].append(int(mix64(s + ODD[0]).sum().view(np.int64)))
                head["mark"].append(int(marks(s)) if marks else 0)
            row, part, cuts = [], [], [0]
            for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                for p, at in enumerate(range(a, max(b, a + 1), TOKENS_A_ROW)):
                    row.append(i)
                    part.append(p)
                    cuts.append(min(b, at + TOKENS_A_ROW))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(take) for c in (0, 1, 2)],
                    *[pa.array(head[c], pa.int64()).take(take) for c in ("n", "d1", "d2", "mark")],
                    pa.array([sketch(s) for s in sets], pa.binary()).take(take),
                    pa.array(part, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(token, pa.int64())),
                ],
                names=["rid", "doc_id", "th", "n", "d1", "d2", "mark", "sketch", "part", "tokens"],
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.xxhash64(text_or_empty(f"`{text}`")).alias("th"),
        text_or_empty(f"`{text}`").alias("text"),
    )
    return rows.mapInArrow(run, shape)


def nodes_of(rows: DataFrame) -> DataFrame:
    """Distinct sets of ``split_off``: ``key, doc_id, th`` of one text, ``n, d1, d2, mark``, the ``least`` doc_id."""
    one = rows.groupBy("n", "d1", "d2")
    agg = one.agg(F.min(F.struct("rid", "doc_id", "th", "sketch")).alias("r"), F.min("doc_id").alias("least"), F.min("mark").alias("mark"))
    return agg.select(F.col("r.rid").alias("key"), F.col("r.doc_id").alias("doc_id"), F.col("r.th").alias("th"), "n", "d1", "d2", "mark", F.col("r.sketch").alias("sketch"), "least")


def split_off(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """What is read of a kept ``emit`` to the end, one row a text: kept without the tokens."""
    return scratch.keep(rows.filter("part = 0").drop("part", "tokens"))


def sets_of(docs: DataFrame, nodes: DataFrame, text: str, doc_id: str, words: int, scratch: Scratch) -> Callable[[DataFrame], DataFrame]:
    """A function from a table of ``key`` to the kept ``(key, shingles)``, read from the texts of just those nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = shingle_sets(column_array(batch, "text"), words)
            same = [
                len(s) == n and mix64(s).sum().view(np.int64) == d
                for s, n, d in zip(sets, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            out = [batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["key", "shingles"]).filter(pa.array(same, pa.bool_()))

    def sets(keys: DataFrame) -> DataFrame:
        # Written, its size is known: a small table is sent to the texts, which then are not shuffled.
        wanted = scratch.keep(nodes.join(keys, "key", "left_semi").select("key", F.col("doc_id").alias("w_id"), F.col("th").alias("w_th"), "n", "d1"))
        have = docs.select(F.col(f"`{doc_id}`").alias("h_id"), text_or_empty(f"`{text}`").alias("text"))
        same = (F.xxhash64(have["text"]) == wanted["w_th"]) & have["h_id"].eqNullSafe(wanted["w_id"])
        rows = have.join(wanted, same).select("key", "n", "d1", "text").mapInArrow(run, "key long, shingles binary")
        out = scratch.keep(rows.groupBy("key").agg(F.first("shingles").alias("shingles")))  # rows that repeat a document are one
        scratch.drop(wanted)
        return out

    return sets


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.count_nonzero(y[at] == x))


def screened(pairs: DataFrame, nodes: DataFrame, limit: Similarity, scratch: Scratch) -> DataFrame:
    """The kept pairs ``(a, b)`` that sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (2, 3))
                ok = may_reach(a, b, batch.column(4).to_numpy(), batch.column(5).to_numpy(), limit)
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok))

    x, y = (nodes.select(F.col("key").alias(k), F.col("sketch").alias("s" + k), F.col("n").alias("n" + k)) for k in ("a", "b"))
    rows = pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb", "na", "nb")
    out = scratch.keep(rows.mapInArrow(run, "a long, b long"))
    scratch.drop(pairs)
    return out


def star_links(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], limit: Similarity, scratch: Scratch) -> DataFrame:
    """The pairs ``(a, b)`` of a kept table that are similar, as kept ``(u, v)``.

    ``a``'s set comes once, then every ``b`` of it streams past; a hot ``a`` is
    dealt to several tasks. Sets of texts in no pair are not read.
    """
    have = sets(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CELL).alias("blocks"))
    dealt = pairs.join(blocks, "a")
    own = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("a").alias("key"), F.lit(0).alias("turn"))
    rest = dealt.select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), F.col("b").alias("key"), F.lit(1).alias("turn"))
    rows = own.unionByName(rest).join(have, "key").select("a", "block", "turn", "key", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, mine = None, None
        for batch in batches:
            u, v = [], []
            a, turn, key = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for x, t, k, s in zip(a, turn, key, batch.column(4), strict=True):
                other = np.frombuffer(s.as_buffer(), np.uint64)
                if t == 0:
                    current, mine = x, other.copy()
                elif current == x and limit.reached(in_common(mine, other), len(mine), len(other)):
                    u.append(x)
                    v.append(k)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    found = rows.repartition("a", "block").sortWithinPartitions("a", "block", "turn", "key").mapInArrow(run, "u long, v long")
    out = scratch.keep(found)
    scratch.drop(have)
    return out


def cell_links(table: pa.Table, limit: Similarity) -> pa.Table:
    """Links ``(u, v)`` that join what is similar between the ``own`` texts of a cell and all its texts."""
    key, group, own = (table.column(c).to_numpy() for c in ("key", "group", "own"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    key, size, own, sets = key[order], size[order], own[order], [sets[i] for i in order]
    _, labels = np.unique(group[order], return_inverse=True)
    token, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    held = np.zeros(len(token), np.int32)
    u, v = [], []
    for i in np.flatnonzero(own).tolist():
        low = int(np.searchsorted(limit.den * size, limit.num * size[i]))
        high = int(np.searchsorted(limit.num * size, limit.den * size[i], side="right"))
        other = low + np.flatnonzero(labels[low:high] != labels[i])
        if not len(other):
            continue
        held[flat[starts[i] : ends[i]]] = 1
        seen = np.concatenate([[0], np.cumsum(held[flat[starts[low] : ends[high - 1]]])])
        both = seen[ends[other] - starts[low]] - seen[starts[other] - starts[low]]
        held[flat[starts[i] : ends[i]]] = 0
        for j in other[limit.reached(both, size[i], size[other])].tolist():
            if labels[j] != labels[i]:
                u.append(key[i])
                v.append(key[j])
                labels[labels == labels[j]] = labels[i]
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def cell_survivors(table: pa.Table, limit: Similarity) -> pa.Table:
    """The texts ``(unit, key)`` of a cell that sketches let be similar to one of another component."""
    table = table.sort_by("size")
    key, group, own, size = (table.column(c).to_numpy() for c in ("key", "group", "own", "size"))
    drawn = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    stay = np.zeros(len(key), bool)
    for i in np.flatnonzero(own).tolist():
        low = int(np.searchsorted(limit.den * size, limit.num * size[i]))
        high = int(np.searchsorted(limit.num * size, limit.den * size[i], side="right"))
        other = low + np.flatnonzero(group[low:high] != group[i])
        if len(other):
            ok = may_reach(drawn[i], drawn[other], size[i], size[other], limit)
            stay[other[ok]] = True
            stay[i] |= ok.any()
    found = np.unique(key[stay])
    return pa.table({"unit": np.full(len(found), table.column("unit")[0].as_py(), np.int64), "key": found})


def in_cells(many: DataFrame, scratch: Scratch) -> DataFrame:
    """Kept ``(unit, key, group, own, i, j)``: in each unit of ``many(unit, key, group)`` the texts outside
    its largest component (``own``) meet all its texts, in cells of bounded size."""
    sized = scratch.keep(divided(many, "unit").filter("others > 0"))
    units = many.join(sized, "unit").withColumns({"parts": F.ceil(F.col("others") / CELL), "blocks": F.ceil(F.col("c") / CELL)})
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    at = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(n))
    mine = units.filter("group <> top").select("unit", "key", "group", F.lit(True).alias("own"), at("parts", 1).alias("i"), upto("blocks").alias("j"))
    rest = units.select("unit", "key", "group", F.lit(False).alias("own"), upto("parts").alias("i"), at("blocks", 2).alias("j"))
    return scratch.keep(mine.unionByName(rest))


def divided(rows: DataFrame, unit: str) -> DataFrame:
    """Per unit its texts ``c``, its largest component ``top`` and the texts outside it."""
    shares = rows.groupBy(unit, "group").agg(F.count("*").alias("m"))
    agg = shares.groupBy(unit).agg(F.sum("m").alias("c"), F.max(F.struct("m", "group")).alias("top"))
    return agg.select(unit, "c", F.col("top.group").alias("top"), (F.col("c") - F.col("top.m")).alias("others"))


def joined(
    rows: DataFrame, heads: DataFrame, nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], limit: Similarity, scratch: Scratch, known: DataFrame | None = None
) -> DataFrame:
    """``(u, v)``: every node but the smallest of its component, with that one.

    ``rows`` is a kept ``emit`` (dropped here) with its ``heads`` and ``nodes``;
    ``known`` are links ``(u, v)`` already found. The components are those of
    all similar pairs of nodes that share a token.
    """
    # Copies of a set are fewer than sets, so the table that may travel to the tokens is that of the copies.
    copies = scratch.keep(heads.select("rid").join(nodes.select(F.col("key").alias("rid")), "rid", "left_anti"))
    one = rows.join(copies, "rid", "left_anti")
    spread = one.select(F.explode("tokens").alias("token"), F.col("rid").alias("key"), "n")
    shared = scratch.keep(spread.groupBy("token").count().filter("count > 1").select("token"))
    raw = scratch.keep(spread.join(shared, "token").select("token", "key", "n"))
    scratch.drop(shared, rows, copies)
    each = raw.groupBy("token").agg(
        F.count("*").alias("c"),
        F.bit_xor(F.xxhash64("key")).alias("x"),
        F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"),
    )
    lists = scratch.keep(each.groupBy("c", "x", "y").agg(F.min("token").alias("token")).select("token", "c"))
    members = scratch.keep(raw.join(lists, "token").select("token", "key", "n", "c"))
    scratch.drop(raw, lists)

    def grouped(rows: DataFrame, links: DataFrame | None) -> DataFrame:
        if links is None:
            return rows.withColumn("group", F.col("key"))
        star = components(links, scratch).select(F.col("u").alias("key"), F.col("v").alias("root"))
        return rows.join(star, "key", "left").withColumn("group", F.coalesce("root", "key")).drop("root")

    def long_enough(x: str, y: str):
        return F.least(x, y) * limit.den >= F.greatest(x, y) * limit.num

    weight = members.groupBy("key").agg(F.sum("c").alias("w"))
    ranked = scratch.keep(grouped(members.join(weight, "key"), known))
    leaders = scratch.keep(ranked.groupBy("token").agg(F.max(F.struct("w", "key", "n", "group")).alias("lead")))
    pairs = scratch.keep(
        ranked.join(leaders, "token")
        .filter("group <> lead.group")
        .filter(long_enough("n", "lead.n"))
        .select(F.col("lead.key").alias("a"), F.col("key").alias("b"))
        .distinct()
    )
    pairs = screened(pairs, nodes, limit, scratch)
    # Each text meets its greatest leader first: then most others of its leaders are in its component.
    great = pairs.join(weight.withColumnRenamed("key", "a"), "a")
    first = scratch.keep(great.groupBy("b").agg(F.max(F.struct("w", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"))
    links = star_links(first, sets, limit, scratch)
    if known is not None:
        links = scratch.keep(links.unionByName(known.select("u", "v")))
    for end in ("a", "b"):
        pairs = grouped(pairs.withColumnRenamed(end, "key"), links).withColumnsRenamed({"key": end, "group": "group_" + end})
    more = scratch.keep(pairs.filter("group_a <> group_b").select("a", "b"))
    links = scratch.keep(links.unionByName(star_links(more, sets, limit, scratch)))
    scratch.drop(first, more)

    labelled = scratch.keep(grouped(members, links))
    scratch.drop(members)
    open_ = scratch.keep(divided(labelled, "token").filter("others > 0").join(leaders.select("token", F.col("lead.key").alias("unit")), "token"))
    todo = scratch.keep(labelled.join(open_.select("token", "unit"), "token"))
    scratch.drop(labelled, open_, ranked, leaders)

    few = todo.filter(f"c <= {FEW}").select("token", "key", "n", "group")
    one, two = (few.select("token", *[F.col(c).alias(c + s) for c in ("key", "n", "group")]) for s in ("_x", "_y"))
    short = scratch.keep(
        one.join(two, "token")
        .filter("key_x < key_y AND group_x <> group_y")
        .filter(long_enough("n_x", "n_y"))
        .select(F.col("key_x").alias("a"), F.col("key_y").alias("b"))
        .distinct()
    )
    short = screened(short, nodes, limit, scratch)
    some = star_links(short, sets, limit, scratch)

    many = scratch.keep(todo.filter(f"c > {FEW}").select("unit", "key", "group").distinct())
    scratch.drop(todo)
    drawn = in_cells(many, scratch).join(nodes.select("key", "sketch", F.col("n").alias("size")), "key")
    left = drawn.groupBy("unit", "i", "j").applyInArrow(lambda t: cell_survivors(t, limit), "unit long, key long")
    close = scratch.keep(many.join(scratch.keep(left.distinct()), ["unit", "key"], "left_semi"))
    cells = in_cells(close, scratch)
    have = sets(cells.select("key").distinct())
    full = scratch.keep(
        cells.join(have, "key").groupBy("unit", "i", "j").applyInArrow(lambda t: cell_links(t, limit), "u long, v long")
    )
    scratch.drop(short, many, close, cells, have)
    out = components(links.unionByName(some).unionByName(full), scratch)
    scratch.drop(links, some, full)
    return out
