"""Embedding models of typed edges: scores, exact ranks, and training.

Vectors are ``array<double>``.  Complex vectors interleave real and imaginary
parts; a rotation's relation vector holds one phase per complex component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.keys import hash_bucket, ordered_positions, text_hash
from edgeloom.schema import EDGE_TYPES
from edgeloom.session import pin

MODELS = ("distmult", "transe", "rotate", "complex")
SCORE_DIGITS = 9
#: Targets whose differences from a query are taken at once.
CACHE_ROWS = 2048
#: Scores of a cell that are held at once: small arrays are used again, large ones are new memory each time.
HELD_SCORES = 1 << 19
#: Queries below which a cell is not cut finer.
QUERY_ROWS = 512


def _dot(xs: list[Column]) -> Column:
    return sum(xs[1:], xs[0])


def score_column(model: str, s: str, r: str, t: str) -> Column:
    """The score of one (source, relation, target) row of arrays, JVM-side."""
    add = lambda acc, x: acc + x
    zero = F.lit(0.0)
    if model == "distmult":
        sr = F.zip_with(s, r, lambda a, b: a * b)
        return F.aggregate(F.zip_with(sr, F.col(t), lambda a, b: a * b), zero, add)
    if model == "transe":
        sr = F.zip_with(s, r, lambda a, b: a + b)
        return -F.aggregate(F.zip_with(sr, F.col(t), lambda a, b: F.abs(a - b)), zero, add)
    half = F.sequence(F.lit(0), (F.size(s) / 2 - 1).cast("int"))

    def part(name: str, i: Column, off: int) -> Column:
        return F.get(F.col(name), i * 2 + off)

    if model == "rotate":

        def term(i: Column) -> Column:
            cos, sin = F.cos(F.get(F.col(r), i)), F.sin(F.get(F.col(r), i))
            re = part(s, i, 0) * cos - part(s, i, 1) * sin - part(t, i, 0)
            im = part(s, i, 0) * sin + part(s, i, 1) * cos - part(t, i, 1)
            return F.abs(re) + F.abs(im)

        return -F.aggregate(F.transform(half, term), zero, add)
    if model == "complex":

        def term(i: Column) -> Column:
            sre, sim = part(s, i, 0), part(s, i, 1)
            rre, rim = part(r, i, 0), part(r, i, 1)
            return (sre * rre - sim * rim) * part(t, i, 0) + (sre * rim + sim * rre) * part(t, i, 1)

        return F.aggregate(F.transform(half, term), zero, add)
    raise ValueError(f"unknown model {model!r}; expected one of {MODELS}")


def score_triples(
    triples: DataFrame, vectors: DataFrame, relations: DataFrame, keys: Sequence[str], model: str
) -> DataFrame:
    """``score`` of every given triple."""
    keys = list(keys)
    return (
        triples.join(relations.select(*keys, "et", F.col("vec").alias("_r")), [*keys, "et"])
        .join(vectors.select(*keys, F.col("id").alias("src"), F.col("vec").alias("_s")), [*keys, "src"])
        .join(vectors.select(*keys, F.col("id").alias("dst"), F.col("vec").alias("_t")), [*keys, "dst"])
        .withColumn("score", score_column(model, "_s", "_r", "_t"))
        .drop("_s", "_r", "_t")
    )


# --------------------------------------------------------------- block scoring


def _query_vectors(model: str, s: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The part of the score that does not depend on the target."""
    if model == "distmult":
        return s * r
    if model == "transe":
        return s + r
    out = np.empty_like(s)
    if model == "rotate":
        c, n = np.cos(r), np.sin(r)
        out[:, 0::2] = s[:, 0::2] * c - s[:, 1::2] * n
        out[:, 1::2] = s[:, 0::2] * n + s[:, 1::2] * c
        return out
    rre, rim = r[:, 0::2], r[:, 1::2]
    out[:, 0::2] = s[:, 0::2] * rre - s[:, 1::2] * rim
    out[:, 1::2] = s[:, 0::2] * rim + s[:, 1::2] * rre
    return out


def _block_scores(model: str, q: np.ndarray, e: np.ndarray) -> np.ndarray:
    if model in ("distmult", "complex"):
        return q @ e.T
    out = np.empty((len(q), len(e)))
    # A slice of targets and its differences stay in the processor's cache.
    for at in range(0, len(e), CACHE_ROWS):
        part = e[at : at + CACHE_ROWS]
        gap = np.empty_like(part)
        for i in range(len(q)):
            np.subtract(part, q[i], out=gap)
            np.abs(gap, out=gap)
            np.sum(gap, axis=1, out=out[i, at : at + CACHE_ROWS])
    return np.negative(out, out=out)


def best_places(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every row's ``k`` highest scores, ties to smaller ids; rows in order.

    Everything at least as high as a row's k-th score is sorted, so no tie is lost;
    NaN comes last.
    """
    low = -scores
    if low.shape[1] > k:
        row, col = np.nonzero(~(low > np.partition(low, k - 1, axis=1)[:, k - 1 : k]))
    else:
        row, col = (x.ravel() for x in np.indices(low.shape))
    order = np.lexsort((ids[col], low[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep]


def _grid(
    queries: DataFrame, vectors: DataFrame, keys: list[str], block: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides copied over a (query block × entity block) grid of bounded cells.

    Large blocks mean few copies; a small table is cut finer, for a cell per core.
    """
    asked = queries.count()
    n_q = max(1, -(-asked // block))
    n_e = max(1, -(-vectors.count() // block))
    cells = 2 * queries.sparkSession.sparkContext.defaultParallelism
    n_q = max(n_q, min(-(-cells // n_e), asked // QUERY_ROWS))
    qb = F.pmod(F.xxhash64(*keys, "src", "et"), F.lit(n_q)).cast("int")
    eb = F.pmod(F.xxhash64(*keys, "id"), F.lit(n_e)).cast("int")
    left = queries.withColumn("_qb", qb).withColumn(
        "_eb", F.explode(F.sequence(F.lit(0), F.lit(n_e - 1)))
    )
    right = vectors.withColumn("_eb", eb).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))
    )
    return left, right


def _query_table(
    triples: DataFrame, vectors: DataFrame, relations: DataFrame, keys: list[str]
) -> DataFrame:
    heads = triples.select(*keys, "src", "et").distinct()
    return (
        heads.join(relations.select(*keys, "et", F.col("vec").alias("r")), [*keys, "et"])
        .join(vectors.select(*keys, F.col("id").alias("src"), F.col("vec").alias("s")), [*keys, "src"])
    )


def target_ranks(
    triples: DataFrame,
    vectors: DataFrame,
    relations: DataFrame,
    keys: Sequence[str],
    model: str,
    block: int = 16_384,
) -> DataFrame:
    """Exact unfiltered tail rank of every distinct triple among all entities; null without a vector.

    ``rank`` = 1 + higher-scoring targets + equal ones with a smaller id.  Cells
    of the grid hold at most about ``block`` queries and targets and return
    counts only, so no pair of query and entity is ever a row.
    """
    keys = list(keys)
    weighted = triples.groupBy(*keys, "src", "et", "dst").agg(F.count("*").alias("w"))
    truth = vectors.select(*keys, F.col("id").alias("dst"), F.col("vec").alias("t"))
    queries = _query_table(triples, vectors, relations, keys)
    asked = weighted.join(queries, [*keys, "src", "et"]).join(truth, [*keys, "dst"])
    left, right = _grid(asked, vectors.select(*keys, "id", "vec"), keys, block)
    fields = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    named = [*keys, "src", "et", "dst"]
    schema = ", ".join(f"{c} {fields[c]}" for c in named) + ", w long, higher long"

    def count_higher(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if q.empty or e.empty:
            return pd.DataFrame(columns=[*named, "w", "higher"])
        parts = []
        targets = dict(list(e.groupby(keys, sort=False)))
        for key, mine in q.groupby(keys, sort=False):
            theirs = targets.get(key)
            if theirs is None:
                continue
            heads = _query_vectors(model, np.stack(mine["s"]), np.stack(mine["r"]))
            tails, vecs = np.stack(mine["t"]), np.stack(theirs["vec"])
            own = np.array(
                [_block_scores(model, heads[i : i + 1], tails[i : i + 1])[0, 0] for i in range(len(mine))]
            )
            own = np.round(own, SCORE_DIGITS)
            ids, dst = theirs["id"].to_numpy(), mine["dst"].to_numpy()
            higher = np.empty(len(mine), np.int64)
            step = max(1, HELD_SCORES // len(vecs))
            for at in range(0, len(mine), step):
                here = slice(at, at + step)
                scores = np.round(_block_scores(model, heads[here], vecs), SCORE_DIGITS)
                higher[here] = (scores > own[here, None]).sum(axis=1)
                # Ids are compared only where scores are equal.
                row, col = np.nonzero(scores == own[here, None])
                higher[here] += np.bincount(row[ids[col] < dst[here][row]], minlength=len(scores))
            parts.append(mine[[*named, "w"]].assign(higher=higher))
        if not parts:
            return pd.DataFrame(columns=[*named, "w", "higher"])
        return pd.concat(parts)

    counted = left.groupBy("_qb", "_eb").cogroup(right.groupBy("_qb", "_eb")).applyInPandas(
        count_higher, schema
    )
    sizes = vectors.groupBy(*keys).agg(F.count("*").alias("n_entities"))
    ranks = counted.groupBy(*named).agg((F.sum("higher") + 1).alias("rank"))
    # Edges whose ends or type have no vector stay in the denominator of the metrics.
    return weighted.join(ranks, named, "left").join(sizes, keys)


def top_targets(
    triples: DataFrame,
    vectors: DataFrame,
    relations: DataFrame,
    keys: Sequence[str],
    model: str,
    k: int = 10,
    block: int = 16_384,
) -> DataFrame:
    """The k best targets of each distinct (source, relation): best k per block, then k."""
    keys = list(keys)
    queries = _query_table(triples, vectors, relations, keys)
    left, right = _grid(queries, vectors.select(*keys, "id", "vec"), keys, block)
    fields = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    id_type = dict(vectors.dtypes)["id"]
    named = [*keys, "src", "et"]
    schema = ", ".join(f"{c} {fields[c]}" for c in named) + f", id {id_type}, score double"

    def best(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        rows: list[pd.DataFrame] = []
        if not q.empty and not e.empty:
            targets = dict(list(e.groupby(keys, sort=False)))
            for key, mine in q.groupby(keys, sort=False):
                theirs = targets.get(key)
                if theirs is None:
                    continue
                heads = _query_vectors(model, np.stack(mine["s"]), np.stack(mine["r"]))
                vecs, ids = np.stack(theirs["vec"]), theirs["id"].to_numpy()
                step = max(1, HELD_SCORES // len(vecs))
                for at in range(0, len(mine), step):
                    scores = np.round(_block_scores(model, heads[at : at + step], vecs), SCORE_DIGITS)
                    row, col = best_places(scores, ids, k)
                    rows.append(mine[named].iloc[at + row].assign(id=ids[col], score=scores[row, col]))
        return pd.concat(rows) if rows else pd.DataFrame(columns=[*named, "id", "score"])

    partial = left.groupBy("_qb", "_eb").cogroup(right.groupBy("_qb", "_eb")).applyInPandas(
        best, schema
    )
    order = Window.partitionBy(*named).orderBy(F.desc("score"), "id")
    return partial.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


# -------------------------------------------------------------------- training


def hashed_normals(id_cols: Sequence[str | Column], dim: int, seed: int, scale: float = 0.1) -> Column:
    """``dim`` reproducible N(0, scale) values per row, drawn from hashes."""

    def unit(salt: int, i: Column) -> Column:
        h = F.xxhash64(F.lit(seed), F.lit(salt), i, *[F.col(c) if isinstance(c, str) else c for c in id_cols])
        return (F.pmod(h, F.lit(1 << 40)) + 0.5) / float(1 << 40)

    return F.transform(
        F.sequence(F.lit(1), F.lit(dim)),
        lambda i: F.sqrt(-2.0 * F.log(unit(1, i))) * F.cos(2.0 * np.pi * unit(2, i)) * scale,
    )


def hinge_gradients(
    model: str, s: np.ndarray, r: np.ndarray, t: np.ndarray, n: np.ndarray, margin: float
) -> tuple[np.ndarray, ...]:
    """Hinge loss of each (triple, negative) row and its four gradients."""
    if model == "distmult":
        h = s * r
        loss = margin - (h * t).sum(1) + (h * n).sum(1)
        return loss, (n - t) * r, (n - t) * s, -h, h
    if model == "transe":
        h = s + r
        loss = margin + np.abs(h - t).sum(1) - np.abs(h - n).sum(1)
        sp, sn = np.sign(h - t), np.sign(h - n)
        return loss, sp - sn, sp - sn, -sp, sn
    h = _query_vectors(model, s, r)
    gs = np.empty_like(s)
    if model == "rotate":
        loss = margin + np.abs(h - t).sum(1) - np.abs(h - n).sum(1)
        sp, sn = np.sign(h - t), np.sign(h - n)
        dre, dim_ = (sp - sn)[:, 0::2], (sp - sn)[:, 1::2]
        c, z = np.cos(r), np.sin(r)
        gs[:, 0::2] = dre * c + dim_ * z
        gs[:, 1::2] = -dre * z + dim_ * c
        gr = dre * (-h[:, 1::2]) + dim_ * h[:, 0::2]
        return loss, gs, gr, -sp, sn
    loss = margin - (h * t).sum(1) + (h * n).sum(1)
    d = n - t
    dre, dim_ = d[:, 0::2], d[:, 1::2]
    gs[:, 0::2] = r[:, 0::2] * dre + r[:, 1::2] * dim_
    gs[:, 1::2] = r[:, 0::2] * dim_ - r[:, 1::2] * dre
    gr = np.empty_like(s)
    gr[:, 0::2] = s[:, 0::2] * dre + s[:, 1::2] * dim_
    gr[:, 1::2] = s[:, 0::2] * dim_ - s[:, 1::2] * dre
    return loss, gs, gr, -h, h


def vector_sum(col: str, dim: int) -> Column:
    return F.array(*[F.sum(F.col(col)[i]) for i in range(dim)])


def _gradient_rows(model: str, keys: list[str], margin: float) -> Callable:
    """Per Arrow batch: gradients already summed per touched entity and relation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            s, r, t, n = (np.stack(pdf[c]) for c in ("s", "r", "t", "neg"))
            loss, gs, gr, gt, gn = hinge_gradients(model, s, r, t, n, margin)
            hot = loss > 0
            out = []
            weight = pdf["copies"].to_numpy(dtype=float)
            paid = np.where(hot, loss * weight, 0.0)
            key_cols = pdf[keys]
            for kind, ids, grad in (
                ("e", pdf["src"], gs), ("e", pdf["dst"], gt), ("e", pdf["neg_id"], gn), ("r", pdf["et"], gr),
            ):
                named = key_cols.assign(kind=kind, id=ids.to_numpy())[hot]
                if len(named):
                    codes, index = pd.factorize(pd.MultiIndex.from_frame(named))
                    total = np.zeros((len(index), grad.shape[1]))
                    np.add.at(total, codes, (grad * weight[:, None])[hot])
                    frame = index.to_frame(index=False)
                    frame.columns = [*keys, "kind", "id"]
                    out.append(frame.assign(grad=list(total), loss=0.0))
            per_key = key_cols.assign(loss=paid).groupby(keys, as_index=False)["loss"].sum()
            out.append(per_key.assign(kind="l", id="", grad=[np.zeros(0)] * len(per_key)))
            yield pd.concat(out)[[*keys, "kind", "id", "grad", "loss"]]

    return run


def train(
    train_edges: DataFrame,
    entities: DataFrame,
    keys: Sequence[str],
    model: str = "distmult",
    dim: int = 50,
    epochs: int = 100,
    lr: float = 0.01,
    margin: float = 1.0,
    negatives: int = 5,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Synchronous margin-loss training of all graphs at once.

    Each epoch joins the triples with the current vectors and with hashed
    negative targets, sums gradients per entity (in Arrow batches, then
    map-side, then by key), updates, and L2-normalises entity vectors.
    Negatives are uniform over the whole graph at every size, at the price of
    a vector per negative in the joins; ``training.train_models`` moves less.
    Returns ``(vectors, relations, losses)``; losses has one row per epoch.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; expected one of {MODELS}")
    keys = list(keys)
    width = 2 * dim if model in ("rotate", "complex") else dim
    rel_width = dim if model == "rotate" else width
    numbered = ordered_positions(
        entities.select(*keys, "id").withColumn("h", text_hash(F.lit(seed), *keys, "id")),
        keys, ["h"], hash_bucket("h"), "idx",
    ).drop("h")
    vectors = pin(numbered.withColumn("vec", hashed_normals([*keys, "id"], width, seed)))
    sizes = vectors.groupBy(*keys).agg(F.count("*").alias("n_entities"))
    triples = pin(
        train_edges.groupBy(*keys, "src", "dst", "et").agg(F.count("*").alias("copies"))
        .join(sizes, keys)
    )
    names = ", ".join(f"'{et}'" for et in EDGE_TYPES)
    relations = sizes.select(*keys, F.explode(F.expr(f"array({names})")).alias("et"))
    start = hashed_normals([*keys, "et"], rel_width, seed + 1, np.pi if model == "rotate" else 0.1)
    relations = pin(relations.withColumn("vec", start))
    losses = None
    fields = dict(triples.dtypes)
    schema = ", ".join(f"{k} {fields[k]}" for k in keys)
    schema += ", kind string, id string, grad array<double>, loss double"
    for epoch in range(epochs):
        # One row per (distinct triple, negative), weighted by the parallel copies.
        draws = triples.withColumn(
            "j", F.explode(F.sequence(F.lit(1), F.lit(negatives)))
        ).withColumn(
            "idx",
            F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "j", *keys, "src", "dst", "et"),
                   F.col("n_entities")) + 1,
        )
        neg = vectors.select(*keys, "idx", F.col("id").alias("neg_id"), F.col("vec").alias("neg"))
        heads = vectors.select(*keys, F.col("id").alias("src"), F.col("vec").alias("s"))
        tails = vectors.select(*keys, F.col("id").alias("dst"), F.col("vec").alias("t"))
        rows = (
            draws.join(neg, [*keys, "idx"])
            .filter("neg_id <> dst")
            .join(relations.withColumnRenamed("vec", "r"), [*keys, "et"])
            .join(heads, [*keys, "src"])
            .join(tails, [*keys, "dst"])
            .select(*keys, "src", "dst", "et", "copies", "neg_id", "s", "r", "t", "neg")
        )
        grads = pin(rows.mapInPandas(_gradient_rows(model, keys, margin), schema))
        ent = grads.filter("kind = 'e'").groupBy(*keys, "id").agg(vector_sum("grad", width).alias("g"))
        rel = grads.filter("kind = 'r'").groupBy(*keys, F.col("id").alias("et")).agg(
            vector_sum("grad", rel_width).alias("g")
        )
        step = F.when(
            F.col("g").isNull(), F.col("vec")
        ).otherwise(F.zip_with("vec", "g", lambda v, g: v - g * lr))
        moved = vectors.join(ent, [*keys, "id"], "left").withColumn("vec", step).drop("g")
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
        vectors = pin(
            moved.withColumn("_n", F.greatest(norm, F.lit(1e-8)))
            .withColumn("vec", F.transform("vec", lambda x: x / F.col("_n")))
            .select(*keys, "id", "idx", "vec")
        )
        relations = pin(
            relations.join(rel, [*keys, "et"], "left").withColumn("vec", step).select(*keys, "et", "vec")
        )
        loss = grads.filter("kind = 'l'").groupBy(*keys).agg(F.sum("loss").alias("loss")).withColumn(
            "epoch", F.lit(epoch)
        )
        losses = loss if losses is None else losses.unionByName(loss)
    return vectors.drop("idx"), relations, losses
