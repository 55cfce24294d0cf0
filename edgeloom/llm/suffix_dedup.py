"""Removal of every byte covered by a long string that occurs twice.

Suffixes are sorted by inserting one symbol per document and round, from the
right: the order of the longer suffixes is the old order sorted stably by the
new symbol, which is the round's piece of the collection's Burrows-Wheeler
transform, and a common prefix grows from a range minimum over the old ones.

Rounds over whole texts would be as many as the longest text has bytes, each a
pass over everything. But only strings of ``length`` bytes are asked for, and
equal strings pick the same anchor in them, their 80-byte substring of least
hash. So the collection is the pieces of text around anchors that occur twice,
at most 321 bytes each; pieces are lined up on their anchors, so that equal
strings begin in the same column, and 320 rounds do for any text. Tables of
the checkpoint folder take the place of the files between the steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import Scratch, column_array, query, read, text_or_empty, worker_cache

LENGTH = 200
ANCHOR = 80
#: Bytes handled at once; a longer text is taken in overlapping parts.
SLAB = 1 << 20
#: Different pieces sorted together, and those of one anchor beyond which strings are matched one by one.
PIECES = 16_384
HOT = 65_536

BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
PLACE = np.uint64(SLAB - 1)


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse modulo 2^64, made once a worker."""
    cache = worker_cache()
    if len(cache.get("powers", [[[]]])[0][0]) < n:
        out = []
        for base in BASES:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                pair.append(np.cumprod(p, dtype=np.uint64))
            out.append(tuple(pair))
        cache["powers"] = out
    return cache["powers"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Sums:
    """Prefix sums of a byte array: hashes of any stretches without reading them again."""

    def __init__(self, data: np.ndarray) -> None:
        self.powers = powers(SLAB + 1)
        wide = data.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for up, _ in self.powers:
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(wide * up[: len(data)], out=total[1:])
            self.sums.append(total)

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total, (_, down) = self.sums[which], self.powers[which]
        return (total[end] - total[start]) * down[start]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def slabs(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """``(first text, last text + 1, begin)``: whole texts up to SLAB bytes, or parts of a longer one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLAB, side="right")) - 1
        if j > i:
            yield i, j, int(offsets[i])
            i = j
        else:
            for begin in range(int(offsets[i]), int(offsets[i + 1]) - length + 1, SLAB - length + 1):
                yield i, i + 1, begin
            i += 1


def anchored(offsets: np.ndarray, data: np.ndarray, length: int, anchor: int) -> Iterator[dict[str, np.ndarray]]:
    """Maximal stretches of string starts with one anchor.

    ``row, start, n`` (strings from ``start`` of the row's text on), ``lead``
    (from the first start to the anchor), ``anchor`` and ``piece``, hashes of
    the anchor and of all the bytes the strings cover.
    """
    for i, j, begin in slabs(offsets, length):
        end = min(int(offsets[j]), begin + SLAB)
        part = data[begin:end]
        if len(part) < length:
            continue
        sums = Sums(part)
        at = np.arange(len(part) - anchor + 1)
        h = mixed(sums.of(0, at, at + anchor))
        best = (sliding_min((h & ~PLACE) | at.astype(np.uint64), length - anchor + 1) & PLACE).astype(np.int64)
        row = np.searchsorted(offsets[i : j + 1], begin + np.arange(len(best)), side="right") - 1
        whole = begin + np.arange(len(best)) + length <= offsets[i : j + 1][row + 1]
        new = np.ones(len(best), bool)
        new[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
        starts = np.flatnonzero(new & whole)  # a text's strings come before its tail, which is not whole
        count = np.add.reduceat(whole, starts) if len(starts) else starts
        group = np.cumsum(new)
        same = np.searchsorted(group, group[starts], side="right") - starts
        count = np.minimum(count, same)
        yield {
            "row": row[starts] + i,
            "start": begin + starts - offsets[i : j + 1][row[starts]],
            "n": count,
            "lead": best[starts] - starts,
            "anchor": h[best[starts]].view(np.int64),
            "piece": mixed(
                sums.of(1, starts, starts + count - 1 + length) ^ mixed(sums.of(0, starts, starts + count - 1 + length))
            ).view(np.int64),
        }


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of an array of strings."""
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    return offsets, np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)


def sort_column(order: np.ndarray, common: np.ndarray, symbols: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Insert one symbol before every suffix.

    ``common[i]`` is the common prefix of the suffixes at places i − 1 and i, at
    most ``most``. Suffixes with the same new symbol keep their order; the common
    prefix of neighbours is one more than the least between their old places.
    Symbols above 255 stand for no symbol and match nothing.
    """
    bwt = symbols[order]
    old = np.argsort(bwt, kind="stable")
    bwt = bwt[old]
    grown = np.zeros(len(order), np.uint8)
    same = np.flatnonzero((bwt[1:] == bwt[:-1]) & (bwt[1:] < 256)) + 1
    if len(same):
        ends = np.empty(2 * len(same), np.int64)
        ends[::2], ends[1::2] = old[same - 1] + 1, old[same] + 1
        least = np.minimum.reduceat(np.append(common, np.uint8(255)), ends)[::2]
        grown[same] = np.minimum(least.astype(np.int64) + 1, most)
    return order[old], grown


def repeated_starts(texts: list[bytes], lead: np.ndarray, n: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """For different pieces lined up on their anchors: which of their strings another piece holds.

    A boolean matrix with a row per piece and a column per start, from the piece's first on.
    """
    most = length - anchor
    width = most + length
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    columns = np.full((width, len(texts)), 256, np.int16)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    columns[inside + most - lead[owner], owner] = flat
    order, common = np.arange(len(texts)), np.zeros(len(texts), np.uint8)
    out = np.zeros((len(texts), most + 1), bool)
    for column in range(width - 1, -1, -1):
        order, common = sort_column(order, common, columns[column], length)
        if column <= most:
            full = common >= length
            hit = full.copy()
            hit[:-1] |= full[1:]
            found = order[hit]
            start = column - (most - lead[found])
            ok = (start >= 0) & (start < n[found])
            out[found[ok], start[ok]] = True
    return out


def runs_of(flags: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per row the ``[first, last]`` stretches of true values."""
    edge = np.zeros((len(flags), 1), np.int8)
    step = np.diff(np.concatenate([edge, flags.astype(np.int8), edge], axis=1), axis=1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(flags))]
    up, down = np.nonzero(step == 1), np.nonzero(step == -1)
    for row, a, b in zip(up[0].tolist(), up[1].tolist(), down[1].tolist(), strict=True):
        out[row].append((a, b - 1))
    return out


RUN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
SOLVED = "anchor long, piece long, runs array<struct<first:int,last:int>>"


def _rows_of_pieces(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``(anchor, doc, n)``: how many pieces of a text have an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for got in anchored(*bytes_of(batch.column(1)), length, anchor):
                both = np.stack([got["row"], got["anchor"]])
                both, counts = np.unique(both, axis=1, return_counts=True) if both.shape[1] else (both, np.zeros(0, np.int64))
                yield pa.RecordBatch.from_pydict({"anchor": both[1], "doc": keys[both[0]], "n": counts.astype(np.int32)})

    return docs.select("doc", "text").mapInArrow(run, "anchor long, doc long, n int")


def _pieces(held: DataFrame, length: int, anchor: int, with_text: bool) -> DataFrame:
    """Pieces of the texts of ``held(doc, text, wanted)`` whose anchor, or whose start, is wanted."""
    extra = ", bytes binary" if with_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = bytes_of(column_array(batch, "text"))
            keys, wanted = batch.column(0).to_numpy(), batch.column(2)
            sizes = np.diff(wanted.offsets.to_numpy())
            values = wanted.flatten().to_numpy(zero_copy_only=False)
            pairs = np.stack([np.repeat(np.arange(len(keys)), sizes), values])
            asked = pairs[:, np.lexsort((pairs[1], pairs[0]))]
            tags = mixed(asked[1].astype(np.int64).view(np.uint64) + asked[0].astype(np.uint64) * np.uint64(BASES[0]))
            tags.sort()
            for got in anchored(offsets, data, length, anchor):
                key = got["start"] if with_text else got["anchor"]
                tag = mixed(key.view(np.uint64) + got["row"].astype(np.uint64) * np.uint64(BASES[0]))
                at = np.minimum(np.searchsorted(tags, tag), max(0, len(tags) - 1))
                keep = np.flatnonzero(tags[at] == tag) if len(tags) else np.zeros(0, np.int64)
                columns = {
                    "anchor": got["anchor"][keep],
                    "piece": got["piece"][keep],
                    "doc": keys[got["row"][keep]],
                    "start": got["start"][keep],
                    "lead": got["lead"][keep].astype(np.int32),
                    "n": got["n"][keep].astype(np.int32),
                }
                if with_text:
                    begin = offsets[got["row"][keep]] + got["start"][keep]
                    columns["bytes"] = pa.array(
                        [data[a : a + m].tobytes() for a, m in zip(begin.tolist(), (got["n"][keep] - 1 + length).tolist(), strict=True)],
                        pa.binary(),
                    )
                yield pa.RecordBatch.from_pydict(columns)

    return held.select("doc", "text", "wanted").mapInArrow(
        run, f"anchor long, piece long, doc long, start long, lead int, n int{extra}"
    )


def _sorted(pieces: DataFrame, buckets: int, length: int, anchor: int) -> DataFrame:
    """``SOLVED`` of different pieces, sorted bucket by bucket; an anchor is in one bucket."""

    def solve(table: pa.Table) -> pa.Table:
        flags = repeated_starts(
            table.column("bytes").to_pylist(), table.column("lead").to_numpy(), table.column("n").to_numpy(), length, anchor
        )
        return pa.table({"anchor": table.column("anchor"), "piece": table.column("piece"), "runs": pa.array(runs_of(flags), RUN)})

    return (
        pieces.withColumn("bucket", F.pmod(F.col("anchor"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInArrow(solve, SOLVED)
        .filter("size(runs) > 0")
    )


def _string_by_string(pieces: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """``SOLVED`` of pieces around an anchor with too many of them: its strings meet by 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, p, k, s = [], [], [], []
            columns = (batch.column(i).to_pylist() for i in range(4))
            for anchor, piece, n, raw in zip(*columns, strict=True):
                for i in range(n):
                    digest = hashlib.blake2b(raw[i : i + length], digest_size=16).digest()
                    a.append(anchor), p.append(piece), k.append(i), s.append(digest)
            yield pa.RecordBatch.from_pydict(
                {"anchor": pa.array(a, pa.int64()), "piece": pa.array(p, pa.int64()), "k": pa.array(k, pa.int32()), "digest": pa.array(s, pa.binary())}
            )

    strings = scratch.keep(pieces.select("anchor", "piece", "n", "bytes").mapInArrow(run, "anchor long, piece long, k int, digest binary"))
    twice = scratch.keep(strings.groupBy("digest").agg(F.count("*").alias("c")).filter("c > 1").select("digest"))
    return (
        strings.join(twice, "digest")
        .groupBy("anchor", "piece")
        .agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: F.struct(k.alias("first"), k.alias("last"))).alias("runs"))
    )


def repeated_intervals(
    docs: DataFrame, scratch: Scratch, length: int = LENGTH, anchor: int = ANCHOR, pieces: int = PIECES, hot: int = HOT
) -> tuple[DataFrame, DataFrame]:
    """``(held, covered)``: kept rows ``(doc, doc_id, text)`` that may lose bytes, and their
    ``(doc, doc_id, spans)``, the unsorted byte stretches ``[start, end)`` of repeated strings.

    ``docs`` has ``doc`` (a hash of the row), ``doc_id`` and ``text``.
    """
    found = scratch.keep(_rows_of_pieces(docs, length, anchor))
    twice = scratch.keep(found.groupBy("anchor").agg(F.sum("n").alias("c")).filter("c > 1").select("anchor"))
    listed = scratch.keep(
        found.join(twice, "anchor", "left_semi").groupBy("doc").agg(F.collect_set("anchor").alias("wanted"))
    )
    scratch.drop(found, twice)
    held = scratch.keep(docs.join(listed, "doc").select("doc", "doc_id", "text", "wanted"))
    scratch.drop(listed)
    places = scratch.keep(_pieces(held, length, anchor, with_text=False))
    kinds = scratch.keep(
        places.groupBy("anchor", "piece").agg(F.count("*").alias("c"), F.min(F.struct("doc", "start")).alias("at"))
    )
    per_anchor = scratch.keep(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    # One text of each different piece, where an anchor has several.
    asked = kinds.join(per_anchor, "anchor").groupBy(F.col("at.doc").alias("doc")).agg(F.collect_set("at.start").alias("wanted"))
    one = held.select("doc", "text").join(asked, "doc").dropDuplicates(["doc"])
    texts = scratch.keep(_pieces(one, length, anchor, with_text=True).join(per_anchor, "anchor"))
    total = texts.count()
    solved = scratch.keep(
        _sorted(texts.filter(f"kinds <= {hot}"), max(1, -(-total // pieces)), length, anchor).unionByName(
            _string_by_string(texts.filter(f"kinds > {hot}"), scratch, length)
        )
    )
    # A piece that occurs twice is repeated as a whole.
    whole = kinds.filter("c > 1").select(
        "anchor", "piece", F.lit(True).alias("all"), F.expr("CAST(NULL AS array<struct<first:int,last:int>>)").alias("runs")
    )
    part = solved.join(kinds.filter("c = 1").select("anchor", "piece"), ["anchor", "piece"], "left_semi").select(
        "anchor", "piece", F.lit(False).alias("all"), "runs"
    )
    verdicts = scratch.keep(whole.unionByName(part))
    spans = F.when(
        F.col("all"), F.array(F.struct(F.col("start"), (F.col("start") + F.col("n") - 1 + length).alias("end")))
    ).otherwise(
        F.transform(
            "runs", lambda r: F.struct((F.col("start") + r["first"]).alias("start"), (F.col("start") + r["last"] + length).alias("end"))
        )
    )
    covered = scratch.keep(
        places.join(verdicts, ["anchor", "piece"])
        .select("doc", F.explode(spans).alias("s"))
        .groupBy("doc")
        .agg(F.collect_set("s").alias("spans"))
    )
    scratch.drop(places, kinds, per_anchor, texts, solved, verdicts)
    return held, covered


def cut_out(held: DataFrame, covered: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``: the bytes left, and the merged stretches that went."""
    kind = held.schema["doc_id"].dataType.simpleString()
    struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
            merged, kept = [], []
            for raw, some in zip(texts, spans, strict=True):
                own: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in some or ()):
                    if own and s <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], e)
                    else:
                        own.append([s, e])
                merged.append([{"start": s, "end": e} for s, e in own])
                edges = [0, *[x for pair in own for x in pair], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(merged, struct), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return held.join(covered, "doc", "left").select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` of every row.

    A byte goes if a string of ``length`` bytes over it starts anywhere else too,
    in another row or the same one; strings are those of the input and never
    reach over the end of a text. A null text is empty; texts shorter than
    ``length`` lose nothing; equal rows are repeats of each other; null doc_ids
    are like any other.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("doc", F.xxhash64("doc_id", "text"))
    held, covered = repeated_intervals(rows, scratch, length)
    none = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")
    others = rows.join(held.select("doc").distinct(), "doc", "left_anti").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("spans"), F.col("text").cast("binary").alias("kept")
    )
    return cut_out(held, covered).unionByName(others)


def digests(parts: DataFrame) -> DataFrame:
    """The contract's columns of ``remove_repeats``."""
    return parts.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op4_anchored_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated 200-byte strings."""
    return digests(remove_repeats(read(spark, sf_dir, "documents")))
