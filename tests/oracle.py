"""Run queries on Spark and their SQL on DuckDB over one folder and compare rows: python tests/oracle.py FOLDER NAME..."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        v = v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, folder: str, query, sql: str) -> str:
    """Empty if Spark and DuckDB give the same rows, else what differs."""
    df = query(spark, folder)
    a_columns, a = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    b_columns, b = rows([d[0] for d in cursor.description], cursor.fetchall())
    if a_columns != b_columns:
        return f"columns {a_columns} {b_columns}"
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"{len(a)} and {len(b)} rows; only Spark {only_a}; only DuckDB {only_b}"
    return "" if a else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from loam.session import build_session

    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    found, sql, con = entry.queries(), entry.oracle_sql(), connect(sys.argv[1])
    for name in sys.argv[2:] or sorted(set(found) & set(sql)):
        began = time.time()
        try:
            said = compare(spark, con, sys.argv[1], found[name], sql[name]) or "ok"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said[:900]} ({time.time() - began:.1f} s)", flush=True)
