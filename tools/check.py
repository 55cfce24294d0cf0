"""Run registered queries next to their SQL twins and report differences.

    python tools/check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import importlib
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from edgeloom.catalog import ORACLES, QUERIES  # noqa: E402
from edgeloom.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--modules", default="")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    if args.modules:
        for m in args.modules.split(","):
            importlib.import_module(f"edgeloom.catalog.{m}")
    else:
        from edgeloom.catalog import load_all

        load_all()
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, fn in QUERIES.items():
        if args.names and not any(name == n or name.startswith(n + "_") for n in args.names):
            continue
        try:
            t0 = time.time()
            df = fn(spark, folder)
            got = [tuple(r) for r in df.collect()]
            spent = time.time() - t0
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:900]}", flush=True)
            continue
        if name not in ORACLES:
            print(f"rows {name}: {len(got)} rows {spent:.1f}s  {got[:1]}"[:300], flush=True)
            continue
        con = duckdb.connect()
        con.sql("SET TimeZone='UTC'")
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        try:
            t0 = time.time()
            res = con.execute(ORACLES[name])
            cols = [c[0] for c in res.description]
            want = res.fetchall()
            sql_spent = time.time() - t0
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"SQLF {name}: {str(e)[:900]}", flush=True)
            continue
        g, w = rows_of(df.columns, got), rows_of(cols, want)
        if sorted(df.columns) != sorted(cols):
            bad += 1
            print(f"COLS {name}: {df.columns} vs {cols}", flush=True)
        elif g != w:
            bad += 1
            diff = [(a, b) for a, b in zip(g, w) if a != b][:3]
            print(f"DIFF {name}: {len(g)} vs {len(w)} {diff}", flush=True)
        else:
            print(f"ok   {name}: {len(g)} rows {spent:.1f}s sql {sql_spent:.1f}s", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 100))
