import hashlib
from collections import Counter

import numpy as np
import pytest

from edgeloom.llm import suffix_dedup as S
from edgeloom.llm.common import QUERIES, Scratch
from tests.llm.helpers import docs, folder, gibberish

LONG = 200


def brute(texts, length=LONG):
    """Digest columns by counting every string of ``length`` bytes."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = np.random.default_rng(9)
    passage, other = gibberish(rng, 90), gibberish(rng, 60)
    texts = [gibberish(rng, int(rng.integers(5, 250))) for _ in range(30)]
    texts += [gibberish(rng, 20) + passage + gibberish(rng, 20) for _ in range(6)]
    texts += [passage[:199], passage[3:203], other * 3, "a" * 350, "ab" * 150, "é" * 150, texts[0], texts[0]]
    texts += [None, "", "x", texts[1][:150] + texts[2][:210], passage + passage, gibberish(rng, 30) + "z" * 230]
    return texts


def test_query_equals_brute_force(spark, tmp_path):
    texts = corpus()
    at = folder(tmp_path, documents=docs(spark, list(enumerate(texts))))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_anchored_suffix_dedup"](spark, at).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_equal_rows_null_ids_and_empty_table(spark):
    rng = np.random.default_rng(2)
    text = gibberish(rng, 80)
    table = docs(spark, [(1, text), (1, text), (None, gibberish(rng, 80))]).withColumnRenamed("lang", "doc").withColumnRenamed("source", "spans")
    got = sorted(((r["doc_id"] or 0), len(r["kept"])) for r in S.remove_repeats(table).collect())
    assert got[1:] == [(1, 0), (1, 0)] and got[0][1] > 200
    assert S.remove_repeats(table.limit(0)).count() == 0


def test_hot_anchors_are_matched_string_by_string(spark):
    texts = [t for t in corpus() if t]
    rows = docs(spark, list(enumerate(texts))).selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS doc")
    results = []
    for hot in (1, 1000):
        held, covered = S.repeated_intervals(rows, Scratch(spark), hot=hot, pieces=50)
        results.append(sorted(map(tuple, S.cut_out(held, covered).select("doc_id", "n_bytes", "kept").collect())))
    assert results[0] == results[1]


def test_parts_of_a_long_text_keep_every_string(monkeypatch):
    rng = np.random.default_rng(1)
    raw = gibberish(rng, 3000).encode()
    offsets = np.array([0, len(raw)])
    starts = lambda: sorted(s + k for got in S.anchored(offsets, np.frombuffer(raw, np.uint8), LONG, 80) for s, n in zip(got["start"], got["n"], strict=True) for k in range(n))
    whole = starts()
    monkeypatch.setattr(S, "SLAB", 4096)
    monkeypatch.setattr(S, "PLACE", np.uint64(4095))
    assert starts() == whole == list(range(len(raw) - LONG + 1))


@pytest.mark.parametrize("length,anchor", [(6, 3), (5, 2)])
def test_columns_sorted_one_symbol_at_a_time(length, anchor):
    rng = np.random.default_rng(length)
    for _ in range(30):
        core = bytes(rng.integers(97, 99, anchor).tolist())
        pieces, lead, n = [], [], []
        for _ in range(12):
            first = int(rng.integers(0, length - anchor + 1))
            count = int(rng.integers(1, first + 2))
            left = bytes(rng.integers(97, 99, first).tolist())
            tail = max(0, count - 1 + length - first - anchor)
            pieces.append((left + core + bytes(rng.integers(97, 99, tail).tolist()))[: count - 1 + length])
            lead.append(first), n.append(count)
        got = S.repeated_starts(pieces, np.array(lead), np.array(n), length, anchor)
        for i, piece in enumerate(pieces):
            for k in range(n[i]):
                at = k - lead[i]  # column of the start, seen from the anchor
                want = any(
                    0 <= at + lead[j] and pieces[j][at + lead[j] : at + lead[j] + length] == piece[k : k + length]
                    for j in range(len(pieces))
                    if j != i
                )
                assert got[i, k] == want
