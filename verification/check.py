"""Run queries and their SQL side by side: python -m verification.check [sf_dir] [names...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from barloom import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if kind in ("object", "str") and len(df) and type(df[c].dropna().iloc[0] if df[c].notna().any() else "").__name__ == "date":
            df[c] = pd.to_datetime(df[c])
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(list(df.columns), ignore_index=True)


def differences(spark_df, sql_df: pd.DataFrame) -> str | None:
    got, want = canonical(spark_df.toPandas()), canonical(sql_df)
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} != {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = [f"{c}: {got[c].dtype} != {want[c].dtype}" for c in got.columns
             if str(got[c].dtype) != str(want[c].dtype)]
    bad = {}
    for c in got.columns:
        a, b = got[c], want[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = (~same).idxmax()
            bad[c] = f"{(~same).sum()} rows, first {a[i]!r} != {b[i]!r}"
    return f"{bad or ''} {kinds or ''}" if bad or kinds else None


def main() -> None:
    from verification.oracles import ORACLES
    from verification.queries import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="8g", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, sf_dir)
            df.cache().count()
            t1 = time.time()
            result = "no SQL" if n not in ORACLES else differences(df, con.execute(ORACLES[n]).df())
            df.unpersist()
        except Exception as e:  # report and go on to the next query
            t1, result = time.time(), f"{type(e).__name__}: {str(e)[:1500]}"
        failed += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {n} spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s {result or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} match")


if __name__ == "__main__":
    main()
