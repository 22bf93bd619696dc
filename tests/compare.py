"""Run registered queries next to their check SQL and compare all values.

    python -m tests.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty text if equal; else what differs first."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    got, want = canonical(got), canonical(want)
    for c in got.columns:
        if got[c].isna().any() and {got[c].dtype.kind, want[c].dtype.kind} == {"f", "i"}:  # whole numbers with nulls
            got[c], want[c] = got[c].astype("Float64"), want[c].astype("Float64")
        if len(got) and got[c].dtype != want[c].dtype:
            return f"type of {c}: {got[c].dtype} vs {want[c].dtype}"
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if not same.all():
            at = (~same).idxmax()
            return f"{(~same).sum()} values of {c}, e.g. {got.loc[at].to_dict()} vs {want.loc[at].to_dict()}"
    return ""


def session(cores: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("termsieve")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con, bad = session(), connect(args.sf), 0
    for name in args.names or queries:
        start = time.time()
        try:
            got = queries[name](spark, args.sf).toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
                continue
            start = time.time()
            want = con.execute(oracles[name]).df()
            what = differences(got, want)
            bad += bool(what)
            print(f"{'BAD  ' if what else 'ok   '} {name}: {len(got)} rows, {took:.1f}s, sql {time.time() - start:.1f}s {what}", flush=True)
        except Exception as error:  # report and go on with the other queries
            bad += 1
            print(f"FAIL  {name}: {str(error)[:600]}", flush=True)
            if len(args.names) == 1:
                traceback.print_exc()
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
