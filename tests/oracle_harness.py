"""Local stand-in for the driver's correctness gate.

Runs a registered Spark query and its DuckDB oracle over the same parquet
tables and compares row count, column names and an order-insensitive hash of
the values (columns sorted by name).
"""

from __future__ import annotations

import hashlib
import math
import os
import sys

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(round(v, 9))
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v)


def _digest(columns, rows) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, name: str, sf_dir: str) -> dict:
    from zipledger.plans.queries import REGISTRY
    q = REGISTRY[name]
    sdf = q.run(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    out = {"name": name, "spark_rows": len(s_rows), "columns": sorted(s_cols)}
    if not q.sql:
        out["status"] = "rows-only"
        return out
    con = duck(sf_dir)
    rel = con.sql(q.sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    out["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        out["status"] = f"columns differ: spark={sorted(s_cols)} oracle={sorted(d_cols)}"
        return out
    sn, sh = _digest(s_cols, s_rows)
    dn, dh = _digest(d_cols, d_rows)
    out["status"] = "match" if (sn, sh) == (dn, dh) else "MISMATCH"
    return out


if __name__ == "__main__":
    from zipledger.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session("local[8]", shuffle_partitions=8)
    from zipledger.plans.queries import REGISTRY
    bad = 0
    for n in (names or list(REGISTRY)):
        try:
            r = compare(spark, n, sf)
        except Exception as e:  # report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
