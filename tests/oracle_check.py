"""Run registered Spark queries next to their DuckDB oracles and compare.

    python -m tests.oracle_check [--sf /root/testdata/sf0.01] [name ...]

Compares row count, column names and the multiset of rows (columns sorted by
name): exactly, and with a relative tolerance for floating point.
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, tol: bool):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") if tol else v
    if isinstance(v, Decimal):
        return v.normalize() if v != 0 else Decimal(0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(cols: list[str], rows: list[tuple], tol: bool) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], tol) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    import __spark_entry__ as E

    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = E.queries()[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.sql(E.oracle_sql()[name])
    dcols = res.columns
    drows = res.fetchall()
    t2 = time.time()
    out = {
        "name": name,
        "spark_rows": len(srows),
        "duck_rows": len(drows),
        "cols_match": sorted(scols) == sorted(dcols),
        "exact": False,
        "tolerant": False,
        "spark_sec": round(t1 - t0, 2),
        "duck_sec": round(t2 - t1, 2),
    }
    if out["cols_match"]:
        out["exact"] = _rows(scols, srows, False) == _rows(dcols, drows, False)
        out["tolerant"] = _rows(scols, srows, True) == _rows(dcols, drows, True)
        if not out["tolerant"]:
            a, b = _rows(scols, srows, True), _rows(dcols, drows, True)
            diff = [x for x in a if x not in set(b)][:3]
            out["spark_only_sample"] = diff
            out["duck_only_sample"] = [x for x in b if x not in set(a)][:3]
    else:
        out["spark_cols"], out["duck_cols"] = sorted(scols), sorted(dcols)
    return out


def main(argv: list[str]) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    sys.path.insert(0, ".")
    from apflow.session import get_session
    import __spark_entry__ as E

    spark = get_session("oracle-check", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(a.sf)
    names = a.names or [n for n in E.queries() if n in E.oracle_sql()]
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, a.sf, con)
        except Exception as err:  # report and continue
            r = {"name": n, "error": f"{type(err).__name__}: {str(err)[:400]}"}
        ok = r.get("exact") and r.get("spark_rows") == r.get("duck_rows")
        bad += not ok
        print(("OK   " if ok else "FAIL ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} exact matches")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
