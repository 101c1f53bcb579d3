"""Compare the registered Spark queries with their SQL twins on DuckDB.

    python -m tests.twins SF_DIR [QUERY ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(value) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both results hold the same columns and rows, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} but SQL has {sorted(names)}"
    mine, theirs = bag(df.columns, df.collect()), bag(names, expected)
    if mine == theirs:
        return None
    extra, missing = mine - theirs, theirs - mine
    return (
        f"{sum(mine.values())} rows, SQL {sum(theirs.values())}; {sum(extra.values())} only in Spark, e.g. "
        f"{list(extra)[:2]}; {sum(missing.values())} only in SQL, e.g. {list(missing)[:2]}"
    )


def run(spark: SparkSession, sf_dir: str, names: list[str]) -> int:
    from fairlead.plans.registry import load

    con, bad = database(sf_dir), 0
    catalog = load()
    for name, q in catalog.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = q.build(spark, sf_dir)
            verdict = difference(df, con, q.sql) if q.sql else f"no twin, {df.count()} rows"
            rows = "" if verdict else f"{con.execute('SELECT count(*) FROM (' + q.sql + ')').fetchone()[0]} rows"
            bad += bool(verdict) and bool(q.sql)
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict, rows, bad = f"ERROR {type(error).__name__}: {str(error)[:600]}", "", bad + 1
        print(f"{time.time() - start:6.1f}s {name}: {verdict or 'same'} {rows}", flush=True)
    return bad


if __name__ == "__main__":
    from fairlead.session import get_spark

    session = get_spark("twins")
    session.sparkContext.setLogLevel("ERROR")
    sys.exit(1 if run(session, sys.argv[1], sys.argv[2:]) else 0)
