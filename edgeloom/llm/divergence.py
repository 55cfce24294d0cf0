"""How far each source's words are from its language's, by chunk factorization.

A chunk is what white space separates. Texts are taken in blocks: a block lists
each of its chunks once, under a number, and keeps apart which documents hold it
and how often. Every globally distinct chunk is tokenized once; the numbers of
its terms are joined back to the blocks' lists, and a block, which has its
documents to itself, counts distinct documents and occurrences of its terms. So
a chunk that all documents share is one row a block, and counts add up over
blocks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import Scratch, column_array, query, read, text_or_empty

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCUMENTS = 10
TOP = 10
UNIT = 1_000_000_000

BLOCKS = "block long, code int, chunk string, docs int, held binary"
COUNTS = "lang string, source string, term long, docs long, n long"
#: Chunks whose documents are one row.
SLAB = 10_000


def chunk_blocks(docs: DataFrame) -> DataFrame:
    """``BLOCKS`` of ``docs(lang, source, text)``: a row per distinct chunk of a block, with its number and documents.

    Rows without a chunk have for a slab of chunks, the first of them number
    ``code``, their number, how many occurrences each has (32 bits) and in which
    documents (16 bits an occurrence). Code -1 lists the documents' groups.
    """

    def block_of(batch: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
        def rows(code, chunk, docs, held) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), block)), code, chunk, docs, held], names=["block", "code", "chunk", "docs", "held"])

        lists = pc.ascii_split_whitespace(column_array(batch, "text"))
        coded = lists.flatten().dictionary_encode()
        codes, many = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        owner = np.repeat(np.arange(batch.num_rows, dtype="<u2"), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(codes, kind="stable")  # each chunk's occurrences are one stretch, by document
        held, codes = owner[order], codes[order]
        sizes = np.bincount(codes, minlength=many).astype("<u4")
        starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        new = np.ones(len(held), bool)
        new[1:] = (held[1:] != held[:-1]) | (codes[1:] != codes[:-1])
        docs = np.bincount(codes[new], minlength=many).astype(np.int32)
        number: dict[tuple[str, str], int] = {}
        of_doc = [number.setdefault(x, len(number)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        slabs, kept = [-1], [json.dumps([list(number), of_doc]).encode()]
        for at in range(0, many, SLAB):
            upto = min(many, at + SLAB)
            slabs.append(at)
            kept.append(np.array([upto - at], "<u4").tobytes() + sizes[at:upto].tobytes() + held[starts[at] : starts[upto]].tobytes())
            yield rows(pa.array(np.arange(at, upto, dtype=np.int32)), coded.dictionary[at:upto], pa.array(docs[at:upto]), pa.nulls(upto - at, pa.binary()))
        n = len(slabs)
        yield rows(pa.array(slabs, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array(kept, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                yield from block_of(batch.slice(at, 1 << 16), block)
                block += 1

    return docs.select("lang", "source", "text").mapInArrow(run, BLOCKS)


def terms_of(chunk: Column) -> Column:
    """Terms of a chunk in order, repeats included; only A-Z are lower-cased."""
    return F.regexp_extract_all(F.translate(chunk, UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))


def block_counts(table: pa.Table) -> pa.Table:
    """``COUNTS`` of one block from rows ``block, code, term, held``: terms of its chunks, and its slabs."""
    code, term = table.column("code").to_numpy(), table.column("term")
    slab = np.flatnonzero(term.is_null().to_numpy())
    slab = slab[np.argsort(code[slab])]
    stored = table.column("held").take(pa.array(slab)).to_pylist()
    groups, of_doc = json.loads(stored[0])
    group_of, docs = np.array(of_doc, np.int64), len(of_doc)
    sizes, flat = [np.zeros(0, "<u4")], [np.zeros(0, "<u2")]
    for raw in stored[1:]:
        many = int(np.frombuffer(raw, "<u4", 1)[0])
        sizes.append(np.frombuffer(raw, "<u4", many, 4))
        flat.append(np.frombuffer(raw, "<u2", offset=4 + 4 * many))
    size, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(flat)
    starts = np.cumsum(size) - size
    mine = term.is_valid().to_numpy()
    chunk, term = code[mine].astype(np.int64), table.column("term").drop_null().to_numpy()
    names, term = np.unique(term, return_inverse=True)
    # Every term of a chunk takes all the chunk's occurrences.
    each = size[chunk]
    place = np.arange(each.sum()) + np.repeat(starts[chunk] - (np.cumsum(each) - each), each)
    key, times = np.unique(np.repeat(term.astype(np.int64), each) * docs + flat[place], return_counts=True)
    kinds, inverse = np.unique((key // docs) * len(groups) + group_of[key % docs], return_inverse=True)
    said = [pa.array([g[i] for g in groups], pa.string()).take(pa.array(kinds % len(groups))) for i in (0, 1)]
    return pa.table(
        {
            "lang": said[0],
            "source": said[1],
            "term": names[kinds // len(groups)],
            "docs": np.bincount(inverse, minlength=len(kinds)).astype(np.int64),
            "n": np.bincount(inverse, times, minlength=len(kinds)).astype(np.int64),
        }
    )


def term_counts(docs: DataFrame, least_documents: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Kept ``COUNTS`` of ``docs(lang, source, text)``, terms by number, and kept ``(term, item)`` that names them.

    A term whose chunks have fewer than ``least_documents`` documents between
    them cannot be kept, so it is left out before its chunks are looked up.
    """
    blocks = scratch.keep(chunk_blocks(docs))
    words = blocks.filter("chunk IS NOT NULL").groupBy(F.col("chunk").alias("word")).agg(F.sum("docs").alias("held_by"))
    dictionary = scratch.keep(words.select("word", "held_by", terms_of(F.col("word")).alias("terms")).filter("size(terms) > 0"))
    once = dictionary.select("held_by", F.explode(F.array_distinct("terms")).alias("item"))
    often = once.groupBy("item").agg(F.sum("held_by").alias("d")).filter(F.col("d") >= least_documents)
    named = scratch.keep(often.select(F.monotonically_increasing_id().alias("term"), "item"))
    useful = scratch.keep(dictionary.select("word", F.explode("terms").alias("item")).join(named, "item").select("word", "term"))
    scratch.drop(dictionary)
    # A table after each shuffle: its files go before the next one writes.
    listed = blocks.filter("chunk IS NOT NULL").select("block", "code", "chunk")
    found = scratch.keep(listed.join(useful, F.col("chunk") == F.col("word")).select("block", "code", "term"))
    none = F.lit(None)
    rows = found.withColumn("held", none.cast("binary")).unionByName(
        blocks.filter("chunk IS NULL").select("block", "code", none.cast("long").alias("term"), "held")
    )
    told = scratch.keep(rows.groupBy("block").applyInArrow(block_counts, COUNTS))
    scratch.drop(blocks, useful, found)
    out = scratch.keep(told.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))
    scratch.drop(told)
    return out, named


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT (count + 2) / (total + 2 kept)), exact."""
    wide = lambda x: x.cast("decimal(28,0)")
    part = (wide(count) + 2).cast("decimal(28,0)")
    whole = (wide(total) + wide(kept) * 2).cast("decimal(28,0)")
    return 1 + F.call_function("div", (part * F.lit(UNIT).cast("decimal(10,0)")).cast("decimal(38,0)"), whole)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)² / (p + q)); shares stay below 2³¹, so a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    top: int = TOP,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every occurring (lang, source).

    Part ``pair``: the distance to each other source of the language, over all
    kept terms. Part ``term``: the ``top`` kept terms that the group uses most
    above its language's share. A row of ``docs`` is a document, repeated rows
    are several; null text, language and source count as ''. A group without
    kept terms has distances all the same, 0 if its language keeps no term; an
    empty table gives no rows. Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(text_or_empty(f"`{lang}`").alias("lang"), text_or_empty(f"`{source}`").alias("source"), text_or_empty(f"`{text}`").alias("text"))
    counts, named = term_counts(rows, least_documents, scratch)
    by_lang = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"))
    kept_terms = scratch.keep(by_lang.filter(F.col("docs") >= least_documents).select("lang", "term", "n_lang"))
    langs = kept_terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    found = scratch.keep(counts.select("lang", "source", "term", "n").join(kept_terms, ["lang", "term"]))
    zero = F.lit(0).cast("long")
    groups = scratch.keep(
        rows.select("lang", "source")
        .distinct()
        .join(found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held")), ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select(
            "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "held", "v", "total_lang")]
        )
        .withColumn("base", F.when(F.col("v") > 0, share(zero, F.col("total"), F.col("v"))).otherwise(zero))
    )
    scaled = scratch.keep(
        found.join(groups, ["lang", "source"])
        .withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
        .withColumn("q", share(F.col("n_lang"), F.col("total_lang"), F.col("v")))
        .select("lang", "source", "term", "p", "q", "base")
    )

    # Terms in neither source all give the same value; those in one give it by share; only those in both are joined.
    x, y = (
        groups.select("lang", F.col("source").alias("source" + s), F.col("base").alias("base" + s), F.col("held").alias("held" + s), F.col("v").alias("v" + s)) for s in ("_x", "_y")
    )
    ordered = x.join(y, "lang").filter("source_x < source_y")
    levels = scaled.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    lone = (
        levels.join(groups.select("lang", F.col("source").alias("other"), F.col("base").alias("base_o")), "lang")
        .filter("source <> other")
        .groupBy("lang", F.least("source", "other").alias("source_x"), F.greatest("source", "other").alias("source_y"))
        .agg(F.sum(F.col("m") * gap(F.col("p"), F.col("base_o"))).alias("lone"))
    )
    one, two = (scaled.select("lang", "term", *[F.col(c).alias(c + s) for c in ("source", "p", "base")]) for s in ("_x", "_y"))
    c = F.col
    change = gap(c("p_x"), c("p_y")) - gap(c("p_x"), c("base_y")) - gap(c("base_x"), c("p_y")) + gap(c("base_x"), c("base_y"))
    both = (
        one.join(two, ["lang", "term"])
        .filter("source_x < source_y")
        .groupBy("lang", "source_x", "source_y")
        .agg(F.sum(change).alias("both"))
    )
    keys = ["lang", "source_x", "source_y"]
    distance = scratch.keep(
        ordered.join(lone, keys, "left")
        .join(both, keys, "left")
        .select(
            *keys,
            (
                (c("v_x") - c("held_x") - c("held_y")) * F.when(c("v_x") > 0, gap(c("base_x"), c("base_y"))).otherwise(zero)
                + F.coalesce("lone", zero)
                + F.coalesce("both", zero)
            ).alias("value"),
        )
    )
    mirrored = distance.select(
        "lang", F.explode(F.array(F.struct(c("source_x").alias("source"), c("source_y").alias("item")), F.struct(c("source_y").alias("source"), c("source_x").alias("item")))).alias("s"), "value"
    ).select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    above = (
        scaled.filter("p > q")
        .join(named, "term")
        .select("lang", "source", F.lit("term").alias("part"), "item", gap(c("p"), c("q")).alias("value"))
    )
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = above.withColumn("rank", place).filter(c("rank") <= top)
    return mirrored.withColumn("rank", place).unionByName(best)


SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
l AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM k GROUP BY lang),
f AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM f WHERE f.lang = x.lang AND f.source = x.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) x),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n,
    (1 + ({UNIT}::HUGEINT * (coalesce(f.n, 0) + 2)) // (g.total + 2 * l.v)::HUGEINT)::HUGEINT AS p,
    (1 + ({UNIT}::HUGEINT * (k.n_lang + 2)) // (l.total_lang + 2 * l.v)::HUGEINT)::HUGEINT AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
a AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM a WHERE part = 'pair' OR rank <= {TOP}
"""


@query("op11_chunk_divergence", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all sources of a language and the terms that set each apart."""
    return divergence(read(spark, sf_dir, "documents"))
