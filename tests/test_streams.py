"""Streams into files: late rows, restarts, and batches that run twice."""

import datetime as dt

from edgeloom.streaming import incremental as S

ITEM = "archive_id string, row int, col int, fitness double, item string, seq long"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def put(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_funnel_appends_final_days_and_drops_late_rows(spark, tmp_path):
    schema = "ts timestamp, event_type string"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        stream = S.read_event_stream(spark, f"{source}/*", schema)
        S.append_files(S.stream_funnel(stream, "ts", lateness="1 day"), out, state)
        rows = spark.read.schema("start timestamp, evaluated long, rejected long").parquet(out).collect()
        return sorted((r["start"].day, r["evaluated"], r["rejected"]) for r in rows)

    good, bad = "candidate_evaluated", "candidate_rejected"
    put(spark, source, [(at(1), good), (at(1, 5), bad), (at(2), good)], schema, "a")
    assert run() == []
    put(spark, source, [(at(1, 9), good), (at(5), bad)], schema, "b")
    assert run() == [(1, 2, 1), (2, 1, 0)]
    put(spark, source, [(at(1, 3), good), (at(9), good)], schema, "c")
    # The row of day 1 came after its day was final; day 5 is now final too.
    assert run() == [(1, 2, 1), (2, 1, 0), (5, 0, 1)]
    assert run() == [(1, 2, 1), (2, 1, 0), (5, 0, 1)]


def cells(spark, folder):
    return sorted((r["archive_id"], r["row"], r["col"], r["fitness"], r["item"]) for r in S.read_archive(spark, folder).collect())


def test_archive_goes_on_after_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = [("a", 0, 0, 1.0, "x", 1), ("a", 0, 0, 2.0, "y", 2), ("a", 0, 1, 5.0, "z", 3)]
    second = [("a", 0, 0, 2.0, "tie", 4), ("a", 0, 1, 6.0, "w", 5), ("b", 1, 1, 0.5, "v", 6)]
    for name, rows in (("1", first), ("2", second)):
        put(spark, source, rows, ITEM, name)
        S.stream_archive(S.read_event_stream(spark, f"{source}/*", ITEM), ["archive_id"], out, state)
    want = [("a", 0, 0, 2.0, "y"), ("a", 0, 1, 6.0, "w"), ("b", 1, 1, 0.5, "v")]
    assert cells(spark, out) == want
    S.stream_archive(S.read_event_stream(spark, f"{source}/*", ITEM), ["archive_id"], out, state)
    assert cells(spark, out) == want


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    merge = S.merge_into_archive(out, ["archive_id"])
    one = spark.createDataFrame([("a", 0, 0, 1.0, "x", 1)], ITEM)
    two = spark.createDataFrame([("a", 0, 0, 3.0, "y", 2), ("a", 2, 0, 1.0, "z", 3)], ITEM)
    three = spark.createDataFrame([("a", 0, 0, 2.0, "low", 4)], ITEM)
    for number, batch in enumerate((one, two, three)):
        merge(batch, number)
    once = cells(spark, out)
    merge(three, 2)
    assert cells(spark, out) == once == [("a", 0, 0, 3.0, "y"), ("a", 2, 0, 1.0, "z")]
    assert len(S._versions(spark, out)) == 2
