"""Compare every registered query with its SQL: python tests/check_oracles.py [sf] [names...]."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    t = time.time()
    df = fn(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return f"rows-only {sum(left.values())}", took, 0.0
    t = time.time()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    right = rows_of(columns, cur.fetchall())
    sql_took = time.time() - t
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}", took, sql_took
    if left != right:
        return (
            f"DIFFER {sum(left.values())}/{sum(right.values())}\n   spark {list((left - right).items())[:2]}\n"
            f"   sql   {list((right - left).items())[:2]}"
        ), took, sql_took
    return f"ok {sum(left.values())}", took, sql_took


def main(argv):
    import __spark_entry__ as entry
    from rentweave.session import build_session

    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    spark = build_session("oracles", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        try:
            verdict, took, sql_took = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report every query
            verdict, took, sql_took = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0, 0
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:28} {took:6.1f}s {sql_took:6.1f}s {verdict}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
