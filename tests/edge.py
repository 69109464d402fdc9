"""Folders of edge-case tables: empty, only nulls and repeated rows, and with further columns of clashing names."""

from __future__ import annotations

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq

CLASH = ["key", "value", "score", "line", "n", "pos", "content", "row", "at", "rank", "h", "g", "form", "u", "v", "tf0", "dl", "_zone", "_low", "_bucket", "total", "reason", "pattern", "doc"]


def build(root: str, source: str) -> dict[str, str]:
    out = {k: os.path.join(root, k) for k in ("empty", "nulls", "extra")}
    for p in out.values():
        os.makedirs(p, exist_ok=True)
    for path in glob.glob(f"{source}/*.parquet"):
        t, name = pq.read_table(path), os.path.basename(path)
        pq.write_table(t.slice(0, 0), f"{out['empty']}/{name}")
        nulls = pa.table({f.name: pa.nulls(3, f.type) for f in t.schema}, schema=pa.schema([pa.field(f.name, f.type) for f in t.schema]))
        pq.write_table(nulls, f"{out['nulls']}/{name}")
        for c in CLASH:
            if c not in t.column_names:
                t = t.append_column(c, pa.array(["x"] * len(t)))
        pq.write_table(t, f"{out['extra']}/{name}")
    return out


def rows(df):
    columns = sorted(df.columns)
    return sorted(str([(c, r[c]) for c in columns]) for r in df.collect())


def failures(queries: dict, check) -> list[str]:
    """Names and errors of the queries for which ``check(name, query)`` fails; several run at a time."""
    from concurrent.futures import ThreadPoolExecutor

    def one(item):
        name, query = item
        try:
            check(name, query)
        except Exception as e:  # noqa: BLE001
            return f"{name}: {type(e).__name__} {str(e)[:300]}"

    with ThreadPoolExecutor(6) as pool:
        return [x for x in pool.map(one, sorted(queries.items())) if x]
