"""Run queries in Spark and in DuckDB and compare all rows.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _text(value: object) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, float):
        return repr(float(value))
    return str(value)


def _lines(pdf: pd.DataFrame) -> list[str]:
    columns = [pdf[name].astype(object).map(_text) for name in sorted(pdf.columns)]
    return sorted("|".join(row) for row in zip(*columns, strict=True))


def difference(result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None if names, rows and values are the same."""
    got, wanted = result.toPandas(), con.sql(sql).df()
    if sorted(got.columns) != sorted(wanted.columns):
        return f"columns {sorted(got.columns)} and {sorted(wanted.columns)}"
    kinds = {
        name: (str(got[name].dtype), str(wanted[name].dtype))
        for name in got.columns
        if len(got) and got[name].dtype.kind != wanted[name].dtype.kind
    }
    if kinds:
        return f"types {kinds}"
    left, right = _lines(got), _lines(wanted)
    if left != right:
        only = [sorted(set(a) - set(b))[:3] for a, b in ((left, right), (right, left))]
        return f"{len(left)} and {len(right)} rows; only here {only[0]}, only there {only[1]}"
    return None


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names or QUERIES:
        start = time.perf_counter()
        try:
            result = QUERIES[name](spark, sf_dir)
            found = (
                difference(result, con, ORACLE[name])
                if name in ORACLE
                else f"no SQL, {result.count()} rows"
            )
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        print(f"{name:28s} {time.perf_counter() - start:6.1f}s {found or 'same'}", flush=True)
    print(f"{bad} differ")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
