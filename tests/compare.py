"""Run registered queries on Spark and their SQL on DuckDB and compare all values.

Usage: python -m tests.compare [sf] [name-part ..]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.10g}")
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def types_of(columns: list[str], rows) -> dict[str, set]:
    return {c: {type(row[i]).__name__ for row in rows if row[i] is not None} for i, c in enumerate(columns)}


def compare(spark, con, name: str, build, sql: str, folder: str) -> str | None:
    """None when equal, else what differs."""
    df = build(spark, folder)
    got = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        at = next(i for i in range(len(a)) if a[i] != b[i])
        return f"row {at} of {len(a)}: {sorted(names)}\n    {a[at]}\n    {b[at]}"
    kinds, wanted = types_of(df.columns, got), types_of(names, want)
    wrong = {c: (kinds[c], wanted[c]) for c in kinds if kinds[c] != wanted[c]}
    return f"types {wrong}" if wrong else None


def main() -> int:
    sys.path.insert(0, str(ROOT))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    parts = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        began = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, build, oracles[name], folder)
                size = ""
            else:
                problem, size = None, f" rows only: {build(spark, folder).count()}"
        except Exception as error:  # noqa: BLE001 - the report shows it
            problem, size = f"{type(error).__name__}: {str(error)[:700]}", ""
        bad += problem is not None
        if "-q" not in parts or problem:
            n = con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchall()[0][0] if name in oracles and not problem else ""
            print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - began:.2f}s {n}{size} {problem or ''}", flush=True)
    print(f"{len(queries)} queries, {len(oracles)} with SQL, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
