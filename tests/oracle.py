"""Compare every registered query with its SQL twin; also usable as a script: python tests/oracle.py [sf] [pattern]."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def kind(series: pd.Series) -> str:
    values = series.dropna()
    if values.empty:
        return "?"
    if pd.api.types.is_bool_dtype(series) or isinstance(values.iloc[0], bool):
        return "bool"
    if pd.api.types.is_integer_dtype(series):
        return "int"
    if pd.api.types.is_float_dtype(series):
        return "int" if series.isna().any() and (values == values.round()).all() else "float"
    return type(values.iloc[0]).__name__


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda v: "<null>" if v is None or v is pd.NA or v != v else (f"{v:.9g}" if isinstance(v, float) else str(v)))
        frame[c] = frame[c].str.replace(r"^(-?\d+)\.0$", r"\1", regex=True)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not len(got):
        return "both are empty: nothing was compared"
    for c in got.columns:
        a, b = kind(got[c]), kind(want[c])
        if a != b and "?" not in (a, b):
            return f"column {c}: kind {a} != {b}"
    a, b = canonical(got), canonical(want)
    off = (a != b).any(axis=1)
    if off.any():
        i = off.idxmax()
        return f"{int(off.sum())} rows differ, first {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from pairloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pattern = re.compile(sys.argv[2] if len(sys.argv) > 2 else ".")
    spark = build_session("local[8]", shuffle_partitions=8, **{"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='oracle-')}"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if not pattern.search(name):
            continue
        start = time.time()
        try:
            got = fn(spark, sf).toPandas()
            took = time.time() - start
            verdict = difference(got, con.execute(oracles[name]).df()) if name in oracles else None
            text = "ok" if verdict is None else "DIFF " + verdict
            if name not in oracles:
                text = "rows only"
        except Exception as error:  # report every query, not just the first failure
            verdict, took, got = "error", time.time() - start, pd.DataFrame()
            text = f"ERROR {type(error).__name__} {str(error)[:600]}"
        bad += verdict is not None
        print(f"{name:34s} {took:6.2f}s {len(got):7d} {text}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
