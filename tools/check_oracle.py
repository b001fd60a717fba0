"""Dev harness: run registered Spark queries and their DuckDB oracles side by
side on one scale factor; report row count, column and value agreement."""

from __future__ import annotations

import argparse
import hashlib
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__file__)))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        out = []
        for v in r:
            if v is None or (isinstance(v, float) and v != v):
                out.append("<null>")
            elif isinstance(v, float):
                out.append(f"{v:.6f}")
            elif hasattr(v, "item"):
                out.append(str(v.item()))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    rows.sort()
    return rows


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from edgecraft.session import get_session
    from edgecraft.plans.registry import all_queries, all_oracles
    spark = get_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    qs, os_ = all_queries(), all_oracles()
    names = a.names or sorted(qs)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = qs[n](spark, a.sf)
            pdf = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{n:40s} SPARK-ERROR {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in os_:
            print(f"{n:40s} rows={len(pdf):7d} (no oracle) spark={ts:.1f}s")
            continue
        try:
            odf = con.execute(os_[n]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{n:40s} DUCK-ERROR {str(e)[:300]}")
            bad += 1
            continue
        same_cols = sorted(pdf.columns) == sorted(odf.columns)
        a_rows, b_rows = _norm(pdf), _norm(odf) if same_cols else []
        ok = same_cols and a_rows == b_rows
        msg = "OK " if ok else "MISMATCH"
        print(f"{n:40s} {msg} rows spark={len(pdf)} duck={len(odf)} spark={ts:.1f}s")
        if not ok:
            bad += 1
            if not same_cols:
                print("   cols spark:", sorted(pdf.columns), "\n   cols duck: ", sorted(odf.columns))
            else:
                sa, sb = set(a_rows), set(b_rows)
                print("   only spark:", list(sa - sb)[:3])
                print("   only duck: ", list(sb - sa)[:3])
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
