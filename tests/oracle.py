"""Runs registered queries against their SQL: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import importlib.util
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("rampart").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        f = float(value)
        return None if math.isnan(f) else (int(f) if f == int(f) and abs(f) < 2**53 else (int(value) if isinstance(value, int) else round(f, 6)))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    args = sys.argv[1:]
    folder = f"/root/testdata/sf{args[0] if args else '0.01'}"
    entry = load_entry()
    names = args[1:] or list(entry.queries())
    spark, db = session(), duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            got = df.collect()
            took = time.time() - start
            sql = entry.oracle_sql().get(name)
            if sql is None:
                print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            cur = db.execute(sql)
            want_columns, want = [c[0] for c in cur.description], cur.fetchall()
            a, b = rows_of(df.columns, got), rows_of(want_columns, want)
            if sorted(df.columns) != sorted(want_columns):
                print(f"COLS  {name}: {sorted(df.columns)} / {sorted(want_columns)}", flush=True); bad += 1
            elif a != b:
                only_a, only_b = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
                print(f"DIFF  {name}: {len(a)}/{len(b)} {sorted(df.columns)} got {only_a} want {only_b}", flush=True); bad += 1
            else:
                print(f"ok    {name}: {len(a)} rows {took:.1f}s", flush=True)
        except Exception as exc:
            bad += 1
            print(f"FAIL  {name}: {type(exc).__name__}: {str(exc)[:600]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
