"""Language identification with interpolated Kneser-Ney character models.

One model per language over the characters of a word, with its start and end
marked. Counts come from every training row through Spark; what is kept of a
model are sorted arrays of hashed n-grams. As a context never reaches beyond
the word, a text costs one lookup for each of its distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import (
    Scratch,
    column_array,
    fresh_worker,
    parts_of,
    query,
    read,
    settle,
    split_words,
    sums_by_text,
    text_or_empty,
)

ORDER = 4
#: Hashed n-grams keep this many bits: among ten million different ones, about 45 pairs share a hash.
KEY_BITS = 40
#: Every so many training rows one is not counted but calibrates; of a language at most
#: CALIBRATION_ROWS do, the smallest hashes first.
CALIBRATE_EVERY, CALIBRATION_ROWS = 10, 500
#: A text is rejected this many robust deviations above the cross-entropy of its language's calibration rows.
REJECT_Z = 6.0
#: Calibration rows from which a language has a spread of its own, and the least spread, as a share of the median.
OWN_SPREAD, LEAST_SPREAD = 20, 0.03
UNKNOWN = "und"

#: Bytes of text a worker looks at together.
PART_BYTES = 4 << 20

START, END = ord("^"), ord("$")
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
MIX = np.uint64(0x9E3779B97F4A7C15)

GRAMS = "lang string, k int, key long, ctx long, suffix long, head boolean, n long"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ``^word$`` laid end to end, each one's word and place in it."""
    line = "".join(f"^{w}$" for w in words)
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    return codes, owner, np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def longer(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hash of the k + 1 symbols that end at each place, from the hashes of k (meaningless near the start)."""
    before = np.zeros_like(h)
    before[1:] = h[:-1]
    return _mix((before + codes + np.uint64(1)) * MIX)


def key_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def letters(words: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Runs of letters and their marks in lower case, the word each is from, and runs a word; marks alone are none."""
    runs, owner = [], []
    for i, word in enumerate(words):
        low = word.decode().lower()
        for run in (low,) if low.isalpha() else NOT_LETTERS.split(low):
            if LETTER.search(run):
                runs.append(run)
                owner.append(i)
    return runs, np.array(owner, np.int64), np.bincount(owner, minlength=len(words)) if owner else np.zeros(len(words), np.int64)


def grams_of(texts: pa.Array, langs: list[str], order: int, bits: int) -> Iterator[dict]:
    """Columns of ``GRAMS``: the n-grams of a batch, counted by language."""
    names = sorted(set(langs))
    of = {x: i for i, x in enumerate(names)}
    codes, words, first = split_words(texts)
    row_lang = np.array([of[x] for x in langs], np.int64)
    word_lang = np.repeat(row_lang, np.diff(first))
    weight = np.bincount(word_lang * len(words) + codes, minlength=len(names) * len(words)).reshape(len(names), -1)
    runs, owner, _ = letters(words)
    for at in range(0, len(runs), 40_000):
        part, own = runs[at : at + 40_000], owner[at : at + 40_000]
        symbols, word, place = word_symbols(part)
        h, key = np.zeros_like(symbols), np.zeros(len(symbols), np.int64)
        for k in range(1, order + 1):
            h = longer(h, symbols)
            shorter, key = key, key_of(h, bits)
            here = np.flatnonzero((place >= k - 1) & (place > 0))
            ctx = np.zeros_like(key)
            ctx[1:] = shorter[:-1]
            head = (place[here] == k - 1).astype(np.int64)
            both = (key[here] << 1) | head
            distinct, sample, inverse = np.unique(both, return_index=True, return_inverse=True)
            at_gram = here[sample]
            for i, lang in enumerate(names):
                n = np.bincount(inverse, weight[i][own[word[here]]], minlength=len(distinct)).astype(np.int64)
                got = np.flatnonzero(n)
                if not len(got):  # words without a letter only
                    continue
                yield {
                    "lang": [lang] * len(got),
                    "k": np.full(len(got), k, np.int32),
                    "key": distinct[got] >> 1,
                    "ctx": ctx[at_gram[got]] if k > 1 else np.zeros(len(got), np.int64),
                    "suffix": shorter[at_gram[got]],
                    "head": (distinct[got] & 1).astype(bool),
                    "n": n[got],
                }


@dataclass
class Model:
    """``p_k = share[k][gram] + back[k][context] · p_(k−1)`` for every language at once."""

    langs: list[str]
    order: int
    bits: int
    symbols: int = 2
    grams: dict[int, np.ndarray] = field(default_factory=dict)
    share: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    back: dict[int, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    sharpness: float = 1.0

    def word_costs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each run in each language, and its number of predicted symbols."""
        cost, size = np.zeros((len(runs), len(self.langs))), np.zeros(len(runs), np.int64)
        for at in range(0, len(runs), 25_000):
            codes, word, place = word_symbols(runs[at : at + 25_000])
            p = np.full((len(codes), len(self.langs)), 1.0 / self.symbols, np.float32)
            h, ctx = np.zeros_like(codes), np.zeros(len(codes), np.int64)
            for k in range(1, self.order + 1):
                h = longer(h, codes)
                key = key_of(h, self.bits)
                here = np.flatnonzero((place >= k - 1) & (place > 0))
                before = ctx[here - 1] if k > 1 else np.zeros(len(here), np.int64)
                p[here] = found(self.grams[k], self.share[k], key[here], 0.0) + found(
                    self.contexts[k], self.back[k], before, 1.0
                ) * p[here]
                ctx = key
            use = place > 0
            for j in range(len(self.langs)):
                bits = -np.log2(np.maximum(p[use, j], 1e-12))
                cost[at : at + 25_000, j] = np.bincount(word[use], bits, minlength=word[-1] + 1)
            size[at : at + 25_000] = np.bincount(word[use], minlength=word[-1] + 1)
        return cost, size

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits a symbol of each text in each language, and its symbols."""
        codes, words, first = split_words(texts)
        runs, owner, _ = letters(words)
        cost, size = self.word_costs(runs)
        by_word = np.zeros((len(words), len(self.langs) + 1))
        for j in range(len(self.langs)):
            by_word[:, j] = np.bincount(owner, cost[:, j], minlength=len(words)) if len(owner) else 0
        by_word[:, -1] = np.bincount(owner, size, minlength=len(words)) if len(owner) else 0
        total = np.column_stack([sums_by_text(by_word[:, j][codes], first) for j in range(by_word.shape[1])])
        n = np.rint(total[:, -1]).astype(np.int64)
        return total[:, :-1] / np.maximum(n, 1)[:, None], n

    def predict(self, texts: pa.Array) -> dict[str, np.ndarray | list]:
        h, n = self.entropies(texts)
        best = h.argmin(axis=1)
        rows = np.arange(len(h))
        odds = np.exp(-self.sharpness * (h - h[rows, best][:, None]))
        limit = self.mean[best] + REJECT_Z * self.spread[best] * np.sqrt(1 + 200 / np.maximum(n, 1))
        limit = np.minimum(limit, np.log2(self.symbols))  # what a draw of symbols by no model costs
        none = n == 0
        return {
            "lang": [UNKNOWN if x else self.langs[i] for i, x in zip(best, none, strict=True)],
            "score": np.where(none, 0.0, 1.0 / odds.sum(axis=1)),
            "bits": np.where(none, np.nan, h[rows, best]),
            "rejected": none | (h[rows, best] > limit),
        }


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    """Rows of ``values`` at the sorted ``keys`` equal to ``wanted``."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = values[at]
    out[keys[at] != wanted] = default
    return out


def text_parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of consecutive parts of about PART_BYTES, a longer text alone."""
    return parts_of(texts, PART_BYTES)


def count_grams(train: DataFrame, order: int = ORDER, bits: int = KEY_BITS) -> DataFrame:
    """``GRAMS`` of all rows ``(text, lang)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            texts, langs = column_array(batch, "text"), batch.column(1).to_pylist()
            for at, n in text_parts(texts):
                for got in grams_of(texts.slice(at, n), langs[at : at + n], order, bits):
                    yield pa.RecordBatch.from_pydict(got)

    return (
        train.mapInArrow(run, GRAMS)
        .groupBy("lang", "k", "key", "head")
        .agg(F.min("ctx").alias("ctx"), F.min("suffix").alias("suffix"), F.sum("n").alias("n"))
    )


def kneser_ney(counts: DataFrame, order: int, bits: int) -> DataFrame:
    """``(lang, k, key, ctx, c)``: raw counts where a gram cannot be extended to the left, else
    the number of different symbols that precede it."""
    preceded = (
        counts.filter("k > 1")
        .groupBy("lang", (F.col("k") - 1).alias("k"), F.col("suffix").alias("key"))
        .agg(F.countDistinct("key").alias("before"))
    )
    body = counts.filter(f"k < {order} AND NOT head").join(preceded, ["lang", "k", "key"]).select(
        "lang", "k", "key", "ctx", F.col("before").alias("c")
    )
    whole = counts.filter(f"k = {order} OR head").select("lang", "k", "key", "ctx", F.col("n").alias("c"))
    return body.unionByName(whole).groupBy("lang", "k", "key").agg(F.min("ctx").alias("ctx"), F.sum("c").alias("c"))


def build(rows, langs: list[str], order: int, bits: int) -> Model:
    """The model from the counts of ``kneser_ney`` (a pandas table of all different n-grams)."""
    model = Model(langs, order, bits)
    of = rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    for k in range(1, order + 1):
        at = np.flatnonzero(rows["k"].to_numpy() == k)
        key, ctx, c, lang = rows["key"].to_numpy()[at], rows["ctx"].to_numpy()[at], rows["c"].to_numpy()[at], of[at]
        ones, twos = np.count_nonzero(c == 1), np.count_nonzero(c == 2)
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        keys, where = np.unique(key, return_inverse=True)
        contexts, inside = np.unique(ctx, return_inverse=True)
        flat = inside * len(langs) + lang
        total = np.bincount(flat, c, minlength=len(contexts) * len(langs))
        kinds = np.bincount(flat, minlength=len(contexts) * len(langs))
        share = np.zeros((len(keys), len(langs)), np.float32)
        share[where, lang] = (c - discount) / total[flat]
        back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        model.grams[k] = keys if len(keys) else np.zeros(1, np.int64)
        model.share[k] = share if len(keys) else np.zeros((1, len(langs)), np.float32)
        model.contexts[k] = contexts if len(contexts) else np.full(1, -1, np.int64)
        model.back[k] = (back if len(contexts) else np.ones(len(langs))).reshape(-1, len(langs)).astype(np.float32)
        if k == 1:
            model.symbols = len(keys) + 2
    return model


def calibrate(model: Model, texts: pa.Array, langs: list[str]) -> None:
    """Median and spread of the true language's cross-entropy, and the sharpness of the score.

    The spread is that of long texts; ``predict`` widens it for short ones. It
    is a median deviation, so that mislabelled rows do not widen it. A language
    with few rows takes the spread of all, one without rows the median too.
    """
    h, n = model.entropies(texts)
    truth = np.array([model.langs.index(x) for x in langs], np.int64)
    enough = n >= 20
    own = h[np.arange(len(h)), truth]
    model.mean = np.full(len(model.langs), np.median(own[enough]) if enough.any() else np.inf)
    for i in range(len(model.langs)):
        if (mine := enough & (truth == i)).any():
            model.mean[i] = np.median(own[mine])
    off = np.abs(own / model.mean[truth] - 1) / np.sqrt(1 + 200 / np.maximum(n, 1))
    share = np.full(len(model.langs), 1.4826 * np.median(off[enough]) if enough.any() else 0.0)
    for i in range(len(model.langs)):
        if (mine := enough & (truth == i)).sum() >= OWN_SPREAD:
            share[i] = 1.4826 * np.median(off[mine])
    model.spread = np.where(np.isfinite(model.mean), np.maximum(share, LEAST_SPREAD) * model.mean, 0.0)
    loss = []
    steps = [2.0**i for i in range(-2, 9)]
    for sharp in steps:
        z = -sharp * (h - h.min(axis=1, keepdims=True))
        loss.append(float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(h)), truth])) if len(h) else 0.0)
    model.sharpness = steps[int(np.argmin(loss))]


def train(
    rows: DataFrame, order: int = ORDER, bits: int = KEY_BITS, calibration_rows: int = CALIBRATION_ROWS
) -> Model | None:
    """A model from ``rows(text, lang, order_key)``; None when there is no labelled text.

    All rows are counted but every CALIBRATE_EVERY-th by hash: of those a
    bounded number per language calibrates the rejection on texts the counts
    have not seen.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    apart = F.pmod(F.col("order_key"), F.lit(CALIBRATE_EVERY)) == 0
    counts = scratch.keep(count_grams(rows.filter(~apart).select("text", "lang"), order, bits))
    table = kneser_ney(counts, order, bits).toPandas()
    if table.empty:
        return None
    langs = sorted(table["lang"].unique())
    model = build(table, langs, order, bits)
    sample = smallest(rows.filter(apart & F.col("lang").isin(langs)), calibration_rows).toArrow()
    texts = sample.column("text").combine_chunks()
    calibrate(model, texts, sample.column("lang").to_pylist())
    scratch.drop(counts)
    return model


def smallest(rows: DataFrame, n: int) -> DataFrame:
    """About the first ``2 n`` hashes of each language by its count, cut to ``n``; texts join only the chosen."""
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    share = (F.col("order_key") / F.lit(2.0**64)) + 0.5  # the hash as a number from 0 to 1
    totals = rows.groupBy("lang").agg(F.count("*").alias("total"))
    few = keyed.select("lang", "order_key", "doc_id", "text_key").join(F.broadcast(totals), "lang").filter(share * F.col("total") < 2 * n)
    order = Window.partitionBy("lang").orderBy("order_key", "doc_id", "text_key")
    chosen = few.withColumn("_r", F.row_number().over(order)).filter(f"_r <= {n}").select("lang", "doc_id", "text_key").distinct()
    return keyed.join(F.broadcast(chosen), ["lang", "doc_id", "text_key"]).select("lang", "text")


def held_out(doc_id: Column) -> Column:
    """Every fifth document by crc32 of its id; a row without an id is held out too."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", "text", "lang", F.xxhash64(F.col("doc_id")).alias("order_key")
    )


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred, score, bits, rejected``.

    A text that is null, empty or without a letter is ``und``, scored 0 and
    rejected, and so is every text when there is no model. Equal rows get equal
    answers. Columns of ``docs`` are kept; one named like a result is replaced.
    """
    results = ["lang_pred", "score", "bits", "rejected"]
    kept = [f for f in docs.schema.fields if f.name.lower() not in results and (keep is None or f.name in keep)]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "lang_pred string, score double, bits double, rejected boolean"])
    # Arrays and lists only: workers need not be able to import this module. As many entries as different n-grams.
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else vars(model))

    # A string column that is kept anyway goes to the workers once.
    once = any(f.name == text and f.dataType.simpleString() == "string" for f in kept)
    told = [F.col(f"`{f.name}`") for f in kept] + ([] if once else [text_or_empty(text).alias("_text")])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        own = None if shared.value is None else Model(**shared.value)
        for whole in batches:
            for at, n in text_parts(column_array(whole, text if once else "_text")):
                batch = whole.slice(at, n)
                if own is None:
                    got = {"lang": [UNKNOWN] * n, "score": np.zeros(n), "bits": np.full(n, np.nan), "rejected": np.ones(n, bool)}
                else:
                    got = own.predict(pc.fill_null(column_array(batch, text if once else "_text"), ""))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(names)], pa.array(got["lang"], pa.string()), pa.array(got["score"]), pa.array(got["bits"]), pa.array(got["rejected"])],
                    names=[*names, *results],
                )

    return docs.select(*told).mapInArrow(run, schema)


@query("op10_kneser_ney_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, from models of the rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(training_rows(docs))
    # The text goes to the workers once and does not come back.
    told = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in no known language go; the others keep their columns and rows."""
    settle(spark)
    model = train(training_rows(docs))
    return identify(docs, model).filter(~F.col("rejected")).select(*docs.columns)
