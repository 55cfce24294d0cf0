import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from edgeloom.llm import langid as L
from edgeloom.llm import packing as P
from edgeloom.llm.common import ORACLES, QUERIES
from edgeloom.llm.mixing import mixing_stage
from tests.llm.helpers import docs, folder, gibberish

# --- Mixing -------------------------------------------------------------------------------


def plain_targets(sizes):
    """Share by weight, cap at threefold, share the excess again until nobody is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped, left, total = {}, set(), set(names), sum(sizes.values())
    while left:
        share = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in left)
        over = {s for s in left if share * weight[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
        left -= over
    for s in names:
        target[s] = 3 * sizes[s] if s in capped else share * weight[s]
    return target


def mixture():
    rng = np.random.default_rng(8)
    rows = []
    for source, n in (("b", 400), ("a", 30), (None, 50), ("", 20), ("é", 5), ("zz", 1)):
        rows += [(len(rows) + i, gibberish(rng, int(rng.integers(1, 80))), "en", source) for i in range(n)]
    rows += [(9001, None, None, "b"), (9002, "", None, "empty"), (9003, " \n\t", None, None), (None, "no id at all", None, "a")]
    return rows + [rows[0], rows[0]] + [(9100, gibberish(rng, 20_000), "en", "b")]


def test_mix_comes_near_its_targets(spark, tmp_path):
    rows = mixture()
    at = folder(tmp_path, documents=docs(spark, rows))
    got = QUERIES["op8_systematic_mix"](spark, at).collect()
    assert len(got) == len(rows)
    words = {r[0]: len((r[1] or "").split()) for r in rows}
    by_source = defaultdict(int)
    source = {r[0]: r[3] for r in rows}
    for r in rows:
        by_source[r[3]] += words[r[0]]
    target, taken = plain_targets(by_source), defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == by_source[s]
        assert r["target"] == pytest.approx(target[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in by_source:
        largest = max(words[r[0]] for r in rows if r[3] == s)
        assert abs(taken[s] - target[s]) <= 2 * largest
    again = QUERIES["op8_systematic_mix"](spark, at).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLES['op8_systematic_mix']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_mixing_stage_repeats_rows(spark):
    table = docs(spark, mixture())
    out = mixing_stage(spark, table, "")
    assert out.columns == table.columns
    assert 0.8 < out.count() / table.count() < 1.3
    assert mixing_stage(spark, table.limit(0), "").count() == 0


# --- Packing ------------------------------------------------------------------------------

ODD = ["a <|endoftext|>b's it'S Σας x́", None, "", " \n ", "x\x1cy z \x01 a\x01b", "É" * 10, "don't 12ab3--,,", "word " * 5000]


def test_packed_pieces_are_the_tokenizers(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = ODD + [gibberish(rng, int(rng.integers(1, 1500))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(None, "no id")] + [(8, texts[8])]
    got = QUERIES["op9_sum_of_squares_pack"](spark, folder(tmp_path, documents=docs(spark, rows))).collect()
    tok = Tokenizer.from_file(P.tokenizer_file())
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r["length"] for r in got) // 2048)
    assert len(bins) <= 1.05 * least + 1


def test_each_item_goes_where_the_squares_are_least():
    rng = np.random.default_rng(0)
    items, capacity = rng.integers(1, 31, 400), 30
    bins, offsets = P.sum_of_squares(items, capacity)
    fill = defaultdict(int)
    for size, where, offset in zip(items.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        assert offset == fill[where]

        def squares(levels):
            counts = defaultdict(int)
            for v in levels:
                if 0 < v < capacity:
                    counts[v] += 1
            return sum(c * c for c in counts.values())

        choices = {v for v in fill.values() if v + size <= capacity} | {0}
        after = {}
        for v in choices:
            levels = list(fill.values())
            if v:
                levels.remove(v)
            after[v] = squares([*levels, v + size])
        assert after[offset] == min(after.values())
        fill[where] += size


def test_packing_nothing(spark):
    assert P.pack(docs(spark, [])).count() == 0


# --- Language -----------------------------------------------------------------------------

VOWELS = {"aa": "aeiou", "bb": "äöüyj", "cc": "ñóáéí"}


def labelled(n=240):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        lang = list(VOWELS)[i % 3]
        word = lambda: "".join(rng.choice(list("bcdfglmnprst")) + rng.choice(list(VOWELS[lang])) for _ in range(rng.integers(1, 4)))  # noqa: E731, B023
        rows.append((i, " ".join(word() for _ in range(rng.integers(3, 60))), lang, "s"))
    return rows


def test_held_out_accuracy_and_texts_without_letters(spark, tmp_path):
    rows = labelled()
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 ?! 3", "bb"), (None, rows[0][1], "aa"), (0, rows[0][1], "aa"), (1003, rows[0][1] * 500, None)]
    at = folder(tmp_path, documents=docs(spark, rows + extra))
    got = QUERIES["op10_kneser_ney_language"](spark, at).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert len(held) > 30 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    pred = {r["doc_id"]: r for r in got}
    assert [pred[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert sum(r["rejected"] for r in got if r["doc_id"] in truth) == 0


def test_gibberish_and_unlearned_languages_are_rejected(spark):
    rng = np.random.default_rng(12)
    rows = labelled(600)
    noise = ["".join(rng.choice(list("bcdfglmnprstaeiouöüñó  "), 150)) for _ in range(20)]
    script = ["".join(rng.choice(list("абвгдежзиклмн  "), 150)) for _ in range(20)]
    wrong = [(2000 + i, t, "aa", "s") for i, t in enumerate(noise[:6])]  # mislabelled rows
    few = [(3000, "dada fafa", "dd", "s")]  # no calibration row
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    model = L.train(L.training_rows(docs(spark, rows + wrong + few)))
    import pyarrow as pa

    told = lambda texts: model.predict(pa.array(texts))["rejected"]
    assert np.isfinite(model.mean).all() and "dd" in model.langs
    assert told(noise[6:]).all() and told(script).all()
    assert told(["ж" * 30, "дом"]).all()
    assert told([r[1] for r in held]).sum() == 0


def test_model_is_interpolated_kneser_ney_by_hand():
    """Two words, order 2: counts small enough to work out."""
    import pandas as pd
    import pyarrow as pa

    rows = []
    for got in L.grams_of(pa.array(["ab ac"]), ["x"], 2, 40):
        rows += list(zip(*[np.asarray(got[c]).tolist() for c in ("lang", "k", "key", "ctx", "suffix", "head", "n")], strict=True))
    frame = pd.DataFrame(rows, columns=["lang", "k", "key", "ctx", "suffix", "head", "n"])
    before = frame[frame.k > 1].assign(k=1).groupby("suffix").key.nunique()
    frame["c"] = [r.n if r.k == 2 or r["head"] else before[r.key] for _, r in frame.iterrows()]
    # Bigrams ^a 2, ab 1, ac 1, b$ 1, c$ 1: discount 4 / (4 + 2) = 2/3.
    # Unigrams by preceding symbols: a 1, b 1, c 1, $ 2: discount 3 / (3 + 2) = 3/5, total 5.
    model = L.build(frame[frame.k == 2]._append(frame[(frame.k == 1)].assign(head=False)), ["x"], 2, 40)
    base = 1 / model.symbols
    one = {s: (c - 0.6) / 5 + 0.6 * 4 / 5 * base for s, c in {"a": 1, "b": 1, "c": 1, "$": 2}.items()}
    p = ((2 - 2 / 3) / 2 + 2 / 3 / 2 * one["a"]) * ((1 - 2 / 3) / 2 + 2 / 3 * 2 / 2 * one["b"]) * ((1 - 2 / 3) + 2 / 3 * one["$"])
    cost, size = model.word_costs(["ab"])
    assert size.tolist() == [3]
    assert 2.0 ** -cost[0, 0] == pytest.approx(p, rel=1e-5)


def test_nothing_to_learn_from(spark, tmp_path):
    at = folder(tmp_path, documents=docs(spark, [(1, "some text", None), (2, None, "aa")]))
    got = QUERIES["op10_kneser_ney_language"](spark, at).collect()
    assert {(r["doc_id"], r["lang_pred"]) for r in got} == {(1, "und"), (2, "und")}


# --- Pipeline -----------------------------------------------------------------------------


def test_pipeline_keeps_clean_documents_and_applies_every_stage(spark, tmp_path):
    rows = labelled(150)
    rows += [(500 + i, rows[3][1], "aa", "t") for i in range(5)] + [(600, "?? 12", None, "t"), (601, None, None, None)]
    rows += [(700, rows[4][1] + " password = abcdef123", "bb", "t")]
    at = folder(tmp_path, documents=docs(spark, rows))
    out = corpus_pipeline.run(spark, at).collect()
    seen = {r["doc_id"] for r in out}
    assert not seen & {500, 501, 502, 503, 504, 600, 601}
    table = spark.read.parquet(f"{at}/documents.parquet")
    kept = table
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, at)
        assert kept.columns == table.columns, name
    rest = {r["doc_id"]: r for r in kept.collect()}
    assert set(range(150)) - set(rest) == set()
    assert "password = <secret>" in rest[700]["text"]
    assert {r["doc_id"] for r in out} <= set(rest)
    assert corpus_pipeline.run(spark, folder(tmp_path / "none", documents=table.limit(0))).count() == 0


def test_language_workers_take_bounded_parts_and_drop_what_others_kept(spark, monkeypatch):
    import pyarrow as pa

    from edgeloom.llm.common import worker_cache

    texts = pa.array(["abc", None, "x" * 50, "", "de", "f" * 9])
    monkeypatch.setattr(L, "PART_BYTES", 10)
    parts = list(L.text_parts(texts))
    assert parts == [(0, 2), (2, 1), (3, 2), (5, 1)]
    worker_cache()["tokenizer"] = object()
    L.fresh_worker()
    assert not worker_cache()
    docs = spark.createDataFrame([(1, None), (2, "one two"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["lang_pred"]) for r in L.identify(docs, None).collect()}
    assert got == {1: (None, "und"), 2: ("one two", "und"), 3: ("", "und")}


def test_marks_without_a_letter_are_no_letters():
    words = [x.encode() for x in ("❤️", "́", "1️⃣", "é", "❤️a", "abc")]
    runs, owner, per_word = L.letters(words)
    assert per_word.tolist() == [0, 0, 0, 1, 1, 1]


def test_mixing_and_near_dedup_keep_columns_of_any_name(spark):
    from edgeloom.llm.near_dedup import near_dedup_stage

    rng = np.random.default_rng(2)
    table = docs(spark, [(i, gibberish(rng, 40), "en", "s") for i in range(12)] + [(3, "again"), (3, "again"), (None, "no id")])
    for name in ("_key", "_copy", "_size", "_DOC", "row", "copy", "th", "a.b"):
        table = table.withColumn(name, table["doc_id"] * 7)
    for stage in (mixing_stage, near_dedup_stage):
        out = stage(spark, table, "")
        assert out.columns == table.columns
        rows = out.collect()
        assert len({r["doc_id"] for r in rows}) == 13
        assert all(r[c] == (None if r["doc_id"] is None else 7 * r["doc_id"]) for r in rows for c in table.columns[5:])
