"""Run a registered query in Spark and its SQL in DuckDB and compare all rows.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, directory: str):
    from quiltgraph.plans.catalog import ORACLE, QUERIES

    df = QUERIES[name](spark, directory)
    mine = table_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        return None, len(mine[1]), "rows only"
    cur = con.execute(ORACLE[name])
    theirs = table_of([c[0] for c in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return False, len(mine[1]), f"columns {mine[0]} / {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]) - set(theirs[1]), set(theirs[1]) - set(mine[1])
        return False, len(mine[1]), f"rows {len(mine[1])}/{len(theirs[1])}; only spark {sorted(a)[:2]}; only sql {sorted(b)[:2]}"
    return True, len(mine[1]), ""


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("quiltgraph")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    args = sys.argv[1:]
    directory = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    from quiltgraph.plans.catalog import QUERIES

    spark, con = session(), duck(directory)
    bad = 0
    for name in args or list(QUERIES):
        start = time.time()
        try:
            ok, n, note = compare(spark, con, name, directory)
        except Exception as e:  # noqa: BLE001
            ok, n, note = False, 0, f"{type(e).__name__}: {str(e)[:600]}"
        bad += ok is False
        print(f"{'ok ' if ok else 'ROWS' if ok is None else 'BAD'} {name} {n} {time.time() - start:.1f}s {note[:1500]}", flush=True)
    print("bad:", bad)
