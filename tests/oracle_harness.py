"""Spark-vs-DuckDB comparison of registered queries.

Usage: python tests/oracle_harness.py [--sf DIR] [key ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


EXACT = os.environ.get("ORACLE_EXACT") == "1"


def _canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if EXACT else round(v, 5)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat() if not isinstance(v, str) else v
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if hasattr(v, "item"):
        return _canon(v.item())
    return v


def _rows(df: pd.DataFrame, cols: list[str]):
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_canon(x) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    sc, dc = sorted(spark_pdf.columns), sorted(duck_pdf.columns)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(spark_pdf) != len(duck_pdf):
        return False, f"row count spark={len(spark_pdf)} duck={len(duck_pdf)}"
    a, b = _rows(spark_pdf, sc), _rows(duck_pdf, sc)
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            bad = [(c, p, q) for c, p, q in zip(sc, x, y) if p != q]
            return False, f"row {i} differs: {bad[:4]}"
    return True, "ok"


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args(argv)

    from fraudlens.session import get_spark
    import __spark_entry__ as E

    spark = get_spark("local[8]", shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(args.sf)
    keys = args.keys or list(qs)
    fails = 0
    for k in keys:
        t0 = time.time()
        try:
            sdf = qs[k](spark, args.sf)
            spdf = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            fails += 1
            continue
        ts = time.time() - t0
        if k not in sqls:
            print(f"ROWS {k}: {len(spdf)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            dpdf = con.execute(sqls[k]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:400]}")
            fails += 1
            continue
        ok, msg = compare(spdf, dpdf)
        sd = dict(zip(sdf.columns, [f.dataType.simpleString() for f in sdf.schema.fields]))
        dd = {c: str(t) for c, t in zip(dpdf.columns, dpdf.dtypes)}
        types = " ".join(f"{c}:{sd.get(c)}/{dd.get(c)}" for c in sorted(sd))
        print(f"{'OK  ' if ok else 'FAIL'} {k}: {msg} rows={len(spdf)} {ts:.1f}s | {types}")
        fails += 0 if ok else 1
    print(f"{len(keys) - fails}/{len(keys)} passed")
    spark.stop()
    return fails


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
