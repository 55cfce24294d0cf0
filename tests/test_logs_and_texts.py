import hashlib
import itertools
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import text as T
from edgeloom.operators import experiments as X
from edgeloom.operators import logs as L


def replay(valid, rule, trigger, recovery, fallback=True, late_recovery=False):
    """(streak, mode, span) after every generation, one by one."""
    streak, mode, span, out = 0, "free", 0, []
    for ok in valid:
        if rule == "reset":
            if ok:
                streak, mode, span = 0, "free", 0
            else:
                streak += 1
                if streak >= trigger:
                    mode, span = "constrained", span + 1
                    if span >= recovery:
                        streak, mode, span = 0, "free", 0
        elif fallback:
            if ok:
                streak = 0
                if mode == "constrained" and (span <= recovery or late_recovery):
                    mode, span = "free", 0
            else:
                streak += 1
                if mode == "constrained":
                    span += 1
                elif streak >= trigger:
                    mode, span = "constrained", 0
        out.append((streak, mode, span))
    return out


SETTINGS = [
    *({"rule": "reset", "trigger": t, "recovery": r} for t, r in itertools.product((0, 1, 3), (0, 1, 4))),
    *({"rule": "lock", "trigger": t, "recovery": r} for t, r in ((0, 0), (1, 2), (3, 1), (2, -1))),
    {"rule": "lock", "trigger": 2, "recovery": 1, "late_recovery": True},
    {"rule": "lock", "trigger": 2, "recovery": 1, "fallback": False},
]


@pytest.mark.parametrize("switches", SETTINGS, ids=str)
def test_modes_equal_a_replay(spark, switches):
    rng = np.random.default_rng(5)
    logs = {i: [bool(v) for v in rng.random(60) < p] for i, p in enumerate((0.1, 0.3, 0.5, 0.8, 0.0))}
    rows = [(i, g, v) for i, log in logs.items() for g, v in enumerate(log)]
    turns = spark.createDataFrame(rows, "isl int, generation int, valid boolean")
    got = L.stagnation_mode(turns, ["isl"], F.floor(F.col("generation") / 7), **switches).collect()
    want = {(i, g): state for i, log in logs.items() for g, state in enumerate(replay(log, **switches))}
    assert {(r["isl"], r["generation"]): (r["streak"], r["mode"], r["span"]) for r in got} == want


def test_switches_belong_to_the_lock(spark):
    turns = spark.createDataFrame([], "isl int, generation int, valid boolean")
    with pytest.raises(ValueError):
        L.stagnation_mode(turns, ["isl"], F.lit(0), late_recovery=True)
    assert L.stagnation_mode(turns, ["isl"], F.lit(0), "lock").count() == 0


def test_fingerprint_is_a_tree_of_digests(spark):
    sha = lambda parts: hashlib.sha256(",".join(parts).encode()).hexdigest()
    n = 5000
    values = spark.range(n).select(F.lit("a").alias("split"), F.col("id").alias("at"), (F.col("id") * 3).alias("v"))
    values = values.unionByName(spark.createDataFrame([("b", 3 * 1024**3, None)], "split string, at long, v long"))
    for levels in (1, 3):
        got = {r["split"]: r for r in X.fingerprint(values, ["split"], "at", "v", levels).collect()}
        rows = [f"{i}:{3 * i}" for i in range(n)]
        for _ in range(levels):
            rows = [sha(rows[i : i + 1024]) for i in range(0, len(rows), 1024)]
        assert (got["a"]["fingerprint"], got["a"]["n"]) == (sha(rows), n)
        assert got["b"]["n"] == 1
    splits = X.fingerprint(values, ["split"], "at", "v")
    one = lambda config: X.dataset_fingerprint(splits, [], "split", config).first()
    got = {r["split"]: r for r in splits.collect()}
    lines = ",".join(f"{k}:{got[k]['n']}:{got[k]['fingerprint']}" for k in "ab")
    row = one({"seed": 1, "model_name": "m"})
    assert row["dataset"] == hashlib.sha256(('{"model_name": "m", "seed": 1}|' + lines).encode()).hexdigest()
    assert (row["n_splits"], row["n"]) == (2, n + 1)
    assert one({"seed": 2, "model_name": "m"})["dataset"] != row["dataset"]


def first_decodable(text):
    for at, c in enumerate(text):
        if c == "{":
            try:
                return text[at : json.JSONDecoder().raw_decode(text, at)[1]]
            except json.JSONDecodeError:
                pass
    return None


CASES = [
    'so {"a": {"b": "}"}} end',
    'use { or } and {not json} then {"a": 1}, {"b": 2}',
    'he said "yes {"a": 1} no',
    '{"a": "\\"{"} x {"b": "\\\\"}',
    '{"a": {"b": 1} oops {"c": {}}',
    'it\'s \\{"a": [1, {"b": null}]}',
    '{"open": {"x": 1',
    "{}",
    "{ }{",
    "no braces",
    "",
]


def test_first_object_of_a_text(spark):
    rng = np.random.default_rng(8)
    parts = ['{', '}', '"', '\\', '{"a":', '"b"', '1', ',', ' ', ': ', '{}', 'x', '[', ']', '"k": {"v": 2}']
    texts = CASES + ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(3000)]
    assert [T.open_object(t) for t in texts] == [first_decodable(t) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*CASES, None])], "i int, t string")
    got = {r["i"]: r["json"] for r in T.extract_json(rows, "t").collect()}
    assert got == {i: first_decodable(t) if t else None for i, t in enumerate([*CASES, None])}


@pytest.mark.parametrize("piece", ['{"a" 1} ', '{"a": ', "{x} ", '{"a": "', '{"a": {"b": 1} x', "{ ", "\\", '"{'])
def test_a_megabyte_takes_linear_time(piece):
    began = time.process_time()
    found = T.open_object(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 20
    assert found == ('{"b": 1}' if "b" in piece else None)
