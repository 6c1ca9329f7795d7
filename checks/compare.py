"""Run queries and their SQL twins side by side: python -m checks.compare [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.oracle import oracle_sql
from checks.queries import QUERIES
from qrelia.session import local_session

TABLES = "documents benchmark embeddings conversations events labels pages".split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float).round(6)
        else:
            df[c] = df[c].map(lambda v: "\0" if v is None or v is pd.NA or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sql, bad = oracle_sql(), 0
    for name in wanted:
        began = time.time()
        try:
            ours = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - began
            if name not in sql:
                print(f"{name:32s} rows only  {len(ours):8d} rows {took:6.1f}s", flush=True)
                continue
            began = time.time()
            rel = con.sql(sql[name])
            theirs = rel.df()
            duck = time.time() - began
            a, b = normal(ours.copy()), normal(theirs.copy())
            same = list(a.columns) == list(b.columns) and len(a) == len(b) and a.equals(b)
            detail = ""
            if not same:
                bad += 1
                if list(a.columns) != list(b.columns):
                    detail = f"columns {list(a.columns)} vs {list(b.columns)}"
                elif len(a) != len(b):
                    detail = f"rows {len(a)} vs {len(b)}"
                else:
                    diff = (a != b).any(axis=1)
                    detail = f"{int(diff.sum())} rows differ\n{a[diff].head(3).to_string()}\n{b[diff].head(3).to_string()}"
            types = {c: (str(ours[c].dtype), str(theirs[c].dtype)) for c in ours.columns if c in theirs and str(ours[c].dtype) != str(theirs[c].dtype)}
            print(f"{name:32s} {'ok ' if same else 'BAD'} {len(ours):8d} rows {took:6.1f}s duck {duck:5.1f}s {detail} {types or ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:32s} ERROR {type(e).__name__}: {str(e)[:1500]}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
