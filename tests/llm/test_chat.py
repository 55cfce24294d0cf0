import hashlib

from edgeloom.llm.chat import PROBE, format_conversations, parsed
from edgeloom.llm.common import QUERIES, ORACLES
from tests.llm.helpers import folder

HARD = ["a\\b", "\\", "\\\\#", "### user: x </turn>\n", "<\\/turn>", " </turn>", "", None, "#" * 7, "é😀\n\n", "a: b", "\\:"]


def test_best_branches_of_a_tree(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0),
        ("t", 2, 1, "assistant", "good", 2.0),
        ("t", 3, 1, "assistant", "bad", 0.5),
        ("t", 4, 2, "user", "thanks", 2.0),
        ("t", 5, 2, "user", "also", 2.0),
        ("t", 8, 9, "user", "cycle", 1.0),
        ("t", 9, 8, "user", "cycle", 1.0),
        ("u", 1, 77, "user", "orphan", None),
        ("t", 4, 2, "user", "thanks", 2.0),  # said twice
    ]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    everything = format_conversations(messages).collect()
    assert sorted((r["tree"], r["leaf"]) for r in everything) == [("t", 3), ("t", 4), ("t", 5), ("u", 1)]
    best = {r["tree"]: r for r in format_conversations(messages, per_tree=1).collect()}
    assert best["t"]["leaf"] == 4  # the tie with 5 goes to the smaller leaf
    assert best["t"]["formatted"] == "### user: q </turn>\n### assistant: good </turn>\n### user: thanks </turn>\n"
    (span,) = best["t"]["loss"]
    assert best["t"]["formatted"][span["start"] : span["end"]] == "good"
    assert format_conversations(messages.limit(0)).count() == 0


def test_control_strings_survive_the_round_trip(spark):
    rows = [("t", i, i - 1 if i else None, (HARD[-i - 1] or "assistant")[:40] if i % 3 else "assistant", t, 1.0) for i, t in enumerate(HARD)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    (row,) = format_conversations(messages).select("formatted", "loss", parsed("formatted").alias("turns")).collect()
    assert [(t["role"], t["text"]) for t in row["turns"]] == [(r[3] or "", r[4] or "") for r in rows]
    assert row["formatted"].count("</turn>") == len(rows)
    assert len(row["loss"]) == sum(r[3] == "assistant" for r in rows)


def test_a_long_chain_needs_few_rounds(spark):
    n = 300
    rows = [("t", i, i - 1 if i else None, "user", str(i), 1.0) for i in range(n)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    (row,) = format_conversations(messages).select(parsed("formatted").alias("turns")).collect()
    assert [t["text"] for t in row["turns"]] == [str(i) for i in range(n)]


def test_query_digests(spark, tmp_path):
    rows = [(1, 2, "assistant", None), (1, 1, "user", "hi"), (1, 1, "user", "hi"), (2, 0, None, PROBE), (None, 0, "user", "x" * 30_000), (3, None, "assistant", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    at = folder(tmp_path, conversations=table)
    got = {r["conv_id"]: r for r in QUERIES["op3_reply_tree_chat"](spark, at).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\nhi\nuser\nhi\nassistant\n\n")
    assert got[-7]["loss_sha256"] == sha(PROBE) and got[-7]["loss_chars"] == len(PROBE)
    assert got[2]["turns_sha256"] == sha(f"\n{PROBE}\n") and got[2]["loss_chars"] == 0
    assert got[None]["n_turns"] == 1
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{at}/conversations.parquet/*.parquet')")
    names = list(got[1].asDict())
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op3_reply_tree_chat']})").fetchall()
    assert sorted(map(str, map(tuple, want))) == sorted(str(tuple(r)) for r in got.values())
