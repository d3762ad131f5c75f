"""Run registered queries next to their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else float(x) + 0.0
    if isinstance(x, (np.integer,)):
        return int(x)
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(_cell(y) for y in x)
    return x


def canonical(pdf) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_cell(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_pdf, sql_pdf) -> str | None:
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(sql_pdf.columns)}"
    for c in spark_pdf.columns:
        a, b = spark_pdf[c].dtype, sql_pdf[c].dtype
        if a != b and len(spark_pdf) and not (spark_pdf[c].isna().any() or sql_pdf[c].isna().any()):
            return f"dtype of {c}: {a} vs {b}"
    a, b = canonical(spark_pdf), canonical(sql_pdf)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}"
    return None


def main() -> None:
    from strideframe.plans import QUERIES, SQL
    from strideframe.session import build_session

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = build_session("8")
    con = connect(sf)
    names = [n for n in QUERIES if not sys.argv[1:] or any(a in n for a in sys.argv[1:])]
    for name in names:
        t0 = time.time()
        try:
            got = QUERIES[name](spark, sf).toPandas()
            took = time.time() - t0
            if name in SQL:
                t1 = time.time()
                verdict = compare(got, con.execute(SQL[name]).df()) or "ok"
                print(f"{name:28s} rows={len(got):7d} spark={took:6.2f}s duck={time.time()-t1:6.2f}s {verdict[:600]}", flush=True)
            else:
                print(f"{name:28s} rows={len(got):7d} spark={took:6.2f}s (no sql)\n{got.head(3).to_string() if os.environ.get('SHOW') else ''}", flush=True)
        except Exception as e:  # report and go on to the next query
            print(f"{name:28s} ERROR {str(e).split(chr(10))[0][:400]}", flush=True)


if __name__ == "__main__":
    main()
