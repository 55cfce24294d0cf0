"""Best-fit packing into fixed-length training sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import (
    Scratch,
    column_array,
    query,
    read,
    settle,
    split_words,
    take_ragged,
    text_or_empty,
    worker_cache,
)

LENGTH = 2048
TOKENIZER = "word_bpe_49k.json"
#: Pieces that one task packs; more pieces make more tasks.
PIECES_PER_TASK = 16_384
#: Written between words that are tokenised together; a word holding it goes alone.
BETWEEN = "\x01"

#: Words a worker keeps with their ids before it starts anew, and the longest of them in bytes.
KNOWN_WORDS, LONGEST_KNOWN = 150_000, 40

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_words(tok, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, sizes, flat)``, as ``ids_of_words`` has them, by the tokenizer.

    White space ends a word of this vocabulary and leaves no token, so a text
    has the ids of its words in turn; many words share one call, cut apart again
    at the ids of ``BETWEEN``.
    """
    text = [w.decode() for w in words]
    mark = tok.encode(BETWEEN, add_special_tokens=False).ids
    joined = [i for i, w in enumerate(text) if BETWEEN not in w and "<|" not in w] if len(mark) == 1 else []
    order, parts = [], []
    for at in range(0, len(joined), 16_384):  # an encoding holds far more than its ids
        groups = [joined[i : min(i + 256, at + 16_384)] for i in range(at, min(len(joined), at + 16_384), 256)]
        lines = [f" {BETWEEN} ".join(text[i] for i in g) for g in groups]
        for group, line in zip(groups, tok.encode_batch_fast(lines, add_special_tokens=False), strict=True):
            ids = line.ids
            if ids.count(mark[0]) == len(group) - 1:  # else a word is normalised into the mark
                order += group
                parts.append(np.array([*ids, mark[0]], "<u4"))
    flat = np.concatenate([*parts, np.zeros(0, "<u4")])
    cuts = np.flatnonzero(flat == mark[0])
    gaps = np.diff(cuts, prepend=-1) - 1
    starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    starts[order], sizes[order] = cuts - gaps, gaps
    rest = np.ones(len(words), bool)
    rest[order] = False
    alone = np.flatnonzero(rest).tolist()
    lone = [x.ids for x in tok.encode_batch_fast([text[i] for i in alone], add_special_tokens=False)]
    lens = np.array([len(x) for x in lone], np.int64)
    starts[alone], sizes[alone] = len(flat) + np.cumsum(lens) - lens, lens
    return starts, sizes, np.concatenate([flat, *[np.array(x, "<u4") for x in lone]])


def ids_of_words(tok, words: list[bytes], known: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, sizes, flat)``: word i has the token ids ``flat[starts[i]:starts[i] + sizes[i]]``.

    Only words not met lately are encoded. ``known`` are two generations of
    words with their ids; a word found in the older one moves to the newer, and
    what is not asked for while the newer fills up is forgotten.
    """
    fresh, old = known
    ids = [fresh.get(w) for w in words]
    new = []
    for i, x in enumerate(ids):
        if x is None:
            x = ids[i] = old.get(words[i])
            if x is None:
                new.append(i)
            else:
                fresh[words[i]] = x
    starts, sizes, flat = encode_words(tok, [words[i] for i in new])
    raw = flat.tobytes()
    for i, a, n in zip(new, (4 * starts).tolist(), (4 * sizes).tolist(), strict=True):
        ids[i] = raw[a : a + n]
        if len(words[i]) <= LONGEST_KNOWN:
            fresh[words[i]] = ids[i]
    if len(fresh) > KNOWN_WORDS:
        known[:] = [{}, fresh]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(ids), "<u4")


def pieces_of(texts: pa.Array, path: str, length: int, end_id: int = 0) -> dict[str, np.ndarray]:
    """Columns ``row, piece, start, length, ids_crc32`` of a batch of texts."""
    from tokenizers import Tokenizer

    cache = worker_cache()
    tok = cache.get(path) or cache.setdefault(path, Tokenizer.from_file(path))
    codes, words, first = split_words(texts)
    starts, sizes, flat = ids_of_words(tok, words, cache.setdefault(path + " known", [{}, {}]))
    row, piece, start, size, crc = [], [], [], [], []
    close = np.array([end_id], "<u4").tobytes()
    for at in range(0, len(first) - 1, 256):
        edges = first[at : at + 257]
        some = codes[edges[0] : edges[-1]]
        each = sizes[some]
        stream = take_ragged(starts[some], each, flat)
        ends = np.concatenate([[0], np.cumsum(each)])[edges - edges[0]]
        for i in range(len(edges) - 1):
            raw = stream[ends[i] : ends[i + 1]].tobytes() + close
            for k, begin in enumerate(range(0, len(raw) // 4, length)):
                part = raw[4 * begin : 4 * (begin + length)]
                row.append(at + i)
                piece.append(k)
                start.append(begin)
                size.append(len(part) // 4)
                crc.append(zlib.crc32(part))
    return {
        "row": np.array(row, np.int64),
        "piece": np.array(piece, np.int32),
        "start": np.array(start, np.int64),
        "length": np.array(size, np.int64),
        "ids_crc32": np.array(crc, np.int64),
    }


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of every item, placed one after the other.

    With N(g) open bins of residual gap g, an item of size s in a bin of gap g
    changes the sum of N² by ``2(N(g − s) − N(g)) + 2``; a new bin by
    ``2 N(capacity − s) + 1``, and closing a bin exactly by ``1 − 2 N(s)``. The
    least change wins, among equals the tightest gap.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    counts = np.zeros(capacity + 1, dtype=np.int64)
    gaps: list[int] = []
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        fits = counts[s:]
        change = 2 * (counts[: capacity + 1 - s] - fits) + 2
        change[0] = 1 - 2 * fits[0]
        change[fits == 0] = 1 << 60
        at = int(change.argmin())
        if change[at] > (2 * counts[capacity - s] + 1 if s < capacity else 0):
            where, gap = len(gaps), capacity
            gaps.append(capacity)
        else:
            gap = s + at
            where = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = where, capacity - gap
        gap -= s
        gaps[where] = gap
        if gap:
            open_bins[gap].append(where)
            counts[gap] += 1
    return bins, offsets


def cut(docs: DataFrame, text: str, doc_id: str, length: int, tokenizer: str) -> DataFrame:
    """``PIECES`` of every row of ``docs``; token ids themselves are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pieces_of(column_array(batch, "text"), tokenizer, length)
            row = found.pop("row")
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0).take(pa.array(row)), **{k: pa.array(v) for k, v in found.items()}}
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, PIECES)


def place(pieces: DataFrame, length: int, tasks: int) -> DataFrame:
    """``PLACED``: rows dealt evenly over ``tasks``, each of which packs its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        order = np.lexsort([table.column(c).fill_null(-1).to_numpy() for c in ("start", "ids_crc32", "doc_id", "length")])[::-1]
        table = table.take(pa.array(order))
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), length)
        base = TaskContext.get().partitionId() << 32
        for name, values in (("sequence_id", base + bins), ("offset", offsets)):
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches()

    # Round robin: equal shares whatever the keys, and stable when a task is run again.
    return pieces.repartition(tasks).mapInArrow(run, PLACED)


def pack(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    length: int = LENGTH,
    tokenizer: str | None = None,
    pieces_per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """Pack every row of ``docs`` into sequences of at most ``length`` tokens.

    A null or empty text is the single end token; a row longer than a sequence is
    cut into full ones and a rest; equal rows and rows of one doc_id are packed
    each on its own, null doc_ids too. No piece is split, dropped or shortened.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.keep(cut(docs, text, doc_id, length, tokenizer or tokenizer_file()))
    tasks = -(-pieces.count() // pieces_per_task)
    return place(pieces, length, max(1, tasks))


@query("op9_sum_of_squares_pack")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(read(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the last one, so it returns the packed pieces."""
    settle(spark)
    return pack(docs)
