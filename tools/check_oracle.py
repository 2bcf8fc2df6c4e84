"""Run registered queries in Spark and their SQL oracles in DuckDB; compare.

usage: python tools/check_oracle.py [sf_dir] [name-substring ...]
Prints one line per query: OK / MISMATCH / ERROR, with row counts.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from evalspark.plans.registry import all_oracles, all_queries  # noqa: E402
from evalspark.session import local_session  # noqa: E402
from evalspark.sources.tables import TABLES  # noqa: E402


def norm(v, places):
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NaT:
            return None
    except Exception:
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(round(v, places)) if places is not None else repr(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([norm(x, places) for x in v])
    if hasattr(v, "isoformat"):
        return str(v)
    return str(v)


def digest(pdf, places):
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append("|".join(str(norm(x, places)) for x in rec))
    rows.sort()
    return hashlib.md5("\n".join(rows).encode()).hexdigest(), rows


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    spark = local_session(int(os.environ.get("CHECK_CORES", "8")), int(os.environ.get("CHECK_SHUFFLE", "8")))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, os_ = all_queries(), all_oracles()
    names = [n for n in qs if not pats or any(p in n for p in pats)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = qs[n](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR-SPARK {n}: {type(e).__name__}: {str(e)[:400]}")
            continue
        st = time.time() - t0
        if n not in os_:
            print(f"ROWS-ONLY  {n}: spark rows={len(sdf)} cols={sorted(sdf.columns)} {st:.2f}s")
            continue
        try:
            odf = con.sql(os_[n]).df()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR-SQL  {n}: {str(e)[:600]}")
            continue
        if sorted(sdf.columns) != sorted(odf.columns):
            bad += 1
            print(f"SCHEMA     {n}: spark={sorted(sdf.columns)} sql={sorted(odf.columns)}")
            continue
        h1, r1 = digest(sdf, None)
        h2, r2 = digest(odf, None)
        if h1 == h2:
            print(f"OK         {n}: rows={len(sdf)} {st:.2f}s")
            continue
        g1, q1 = digest(sdf, 6)
        g2, q2 = digest(odf, 6)
        tag = "OK~6" if g1 == g2 else "MISMATCH"
        if tag == "MISMATCH":
            bad += 1
        print(f"{tag:10s} {n}: rows spark={len(sdf)} sql={len(odf)} {st:.2f}s")
        if tag == "MISMATCH":
            s1, s2 = set(q1), set(q2)
            print("   spark-only:", sorted(s1 - s2)[:3])
            print("   sql-only:  ", sorted(s2 - s1)[:3])
            print("   dtypes spark:", dict(sdf.dtypes.astype(str)), " sql:", dict(odf.dtypes.astype(str)))
    print(f"checked {len(names)} queries, {bad} problems")


if __name__ == "__main__":
    main()
