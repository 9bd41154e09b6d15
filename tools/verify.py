"""Run registered queries next to their SQL oracles and report differences.

    python tools/verify.py --sf 0.01 [name-part ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time
import traceback
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(root: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return v


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i].lower())
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i].lower() for i in order], sorted(out, key=repr)


KINDS = {"bigint": "int", "int": "int", "double": "float", "string": "text", "date": "date", "timestamp_ntz": "time", "timestamp": "time", "boolean": "flag",
         "BOOLEAN": "flag", "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "text", "DATE": "date", "TIMESTAMP": "time"}


def odd_types(spark_df, cur):
    """Columns whose kinds differ; widths of integers may differ."""
    ours = {n.lower(): t for n, t in spark_df.dtypes}
    theirs = {c[0].lower(): str(c[1]) for c in cur.description}
    return [(n, ours[n], theirs[n]) for n in ours if KINDS.get(ours[n], ours[n]) != KINDS.get(theirs[n], theirs[n])]


def compare(spark_df, con, sql):
    s_names, s_rows = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    d_names, d_rows = canonical([c[0] for c in cur.description], cur.fetchall())
    if s_names != d_names:
        return f"columns {s_names} != {d_names}", len(s_rows)
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} != {len(d_rows)}", len(s_rows)
    odd = odd_types(spark_df, cur)
    if odd:
        return f"types {odd}", len(s_rows)
    for a, b in zip(s_rows, d_rows):
        if a != b:
            types = [(n, type(x).__name__, type(y).__name__, x, y) for n, x, y in zip(s_names, a, b) if x != y or type(x) is not type(y)]
            return f"first difference {types}", len(s_rows)
    return None, len(s_rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--exact", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from tastemill.plans.catalog import all_queries
    from tastemill.session import local_session

    root = f"/root/testdata/sf{args.sf}"
    spark, con = local_session("8"), connect(root)
    bad = 0
    for name, q in all_queries().items():
        if args.names and not any((n == name) if args.exact else (n in name) for n in args.names):
            continue
        began = time.time()
        try:
            df = q(spark, root)
            problem, n = compare(df, con, q.oracle) if q.oracle else (None, df.count())
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", -1
            if args.exact:
                traceback.print_exc()
        bad += problem is not None
        mark = "FAIL" if problem else ("ok  " if q.oracle else "rows")
        print(f"{mark} {name} rows={n} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
