"""Run registered queries next to their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as spark_entry  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return str(v)


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


FAMILY = {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "int!", "VARCHAR": "str", "DOUBLE": "double",
          "DATE": "date", "TIMESTAMP": "time", "BOOLEAN": "bool", "JSON": "str!", "VARCHAR[]": "strs",
          "INTEGER[]": "ints", "BIGINT[]": "ints", "bigint": "int", "int": "int", "string": "str",
          "double": "double", "date": "date", "timestamp_ntz": "time", "boolean": "bool",
          "array<string>": "strs", "array<int>": "ints", "array<bigint>": "ints"}


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str, int, float]:
    started = time.time()
    df = spark_entry.queries()[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - started
    sql = spark_entry.oracle_sql().get(name)
    if sql is None:
        return True, "rows only", len(got), took
    rel = con.sql(sql)
    want = rel.fetchall()
    kinds = {c: FAMILY.get(str(k), str(k)) for c, k in zip(rel.columns, rel.types)}
    ours = {c: FAMILY.get(k, k) for c, k in df.dtypes}
    if kinds != ours:
        diff = {c: (ours.get(c), kinds.get(c)) for c in {*ours, *kinds} if ours.get(c) != kinds.get(c)}
        return False, f"schema (ours, sql): {diff}", len(got), took
    a, b = _rows(df.columns, got), _rows(rel.columns, want)
    if a == b:
        return True, "equal", len(got), took
    only_a, only_b = a - b, b - a
    return False, (f"{sum(only_a.values())}/{len(got)} only in Spark, {sum(only_b.values())}/{len(want)}"
                   f" only in SQL; {sorted(df.columns)}\n   {list(only_a)[:2]}\n   {list(only_b)[:2]}"), len(got), took


def main(sf_dir: str, wanted: list[str]) -> int:
    from stratalake.session import local_session
    spark, con, bad = local_session("compare"), connect(sf_dir), 0
    for name in spark_entry.queries():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note, n, took = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, note, n, took = False, f"{type(e).__name__}: {str(e)[:1500]}", 0, 0.0
        bad += not ok
        flag = "" if n else "  (NO ROWS)"
        print(f"{'ok ' if ok else 'BAD'} {name:45s} {n:7d} rows {took:6.2f}s {note}{flag}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(os.environ.get("SF_DIR", "/root/testdata/sf0.01"), sys.argv[1:]) > 0)
