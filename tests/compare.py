"""Side-by-side run of a query and its SQL twin."""

from __future__ import annotations

import math
import os
import time

import duckdb

from rollbook.session import drop_cuts

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ").replace("+00:00", "")
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """(ok, message) of one query against its SQL twin."""
    t0 = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    drop_cuts(spark)
    t1 = time.time()
    if sql is None:
        return len(got) > 0, f"{name}: rows={len(got)} spark={t1 - t0:.1f}s (no SQL)"
    con.execute(sql)
    cols = [d[0] for d in con.description]
    want = con.fetchall()
    t2 = time.time()
    head = f"{name}: rows={len(got)}/{len(want)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(cols):
        return False, f"{head} COLUMNS {sorted(df.columns)} != {sorted(cols)}"
    a, b = _rows(df.columns, got), _rows(cols, want)
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        return False, f"{head} DIFF\n  only spark {sorted(sa - sb)[:3]}\n  only sql   {sorted(sb - sa)[:3]}"
    return len(got) > 0, head + ("" if got else " EMPTY")
