"""Compare registered queries with their SQL on DuckDB: python tests/check_oracles.py SF_DIR [name ...]"""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iu" and df[c].isna().any():
            df[c] = df[c].astype("float64")  # integers with NULLs, as the other engine returns them
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v != v else str(v))
    return df


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame, tol: float = 2e-6):
    a, b = normal(spark_df), normal(sql_df)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} vs {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    kinds = lambda d: {c: d[c].dtype.kind for c in d.columns}
    if kinds(a) != kinds(b):
        return f"types {[(c, a[c].dtype, b[c].dtype) for c in a if a[c].dtype.kind != b[c].dtype.kind]}"
    keys = sorted(a.columns, key=lambda c: (a[c].dtype.kind == "f", c))
    a, b = (d.sort_values(keys, kind="mergesort").reset_index(drop=True) for d in (a, b))
    for c in a.columns:
        if a[c].dtype.kind == "f":
            x, y = a[c].to_numpy(), b[c].to_numpy()
            bad = ~((abs(x - y) <= tol * (1 + abs(y))) | ((x != x) & (y != y)))
        else:
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna())).to_numpy()
        if bad.any():
            i = bad.argmax()
            return f"{c}: {bad.sum()} differ, e.g. {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    exact = all((a[c].eq(b[c]) | (a[c].isna() & b[c].isna())).all() for c in a.columns)
    return None if exact else "~close"


def main():
    import __spark_entry__ as entry
    from tests.session import session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in names or queries:
        t = time.time()
        try:
            got = queries[name](spark, sf).toPandas()
            t1 = time.time()
            if name in oracles:
                why = compare(got, con.execute(oracles[name]).df())
            else:
                why = "~no oracle"
        except Exception as e:  # report and go on
            t1, why, got = time.time(), f"{type(e).__name__}: {str(e)[:600]}", []
        print(f"{name:22s} rows={len(got):7d} spark={t1 - t:6.2f}s sql={time.time() - t1:6.2f}s {why or 'ok'}", flush=True)
        if why and not why.startswith("~"):
            failed.append(name)
    print("FAILED", failed)


if __name__ == "__main__":
    main()
