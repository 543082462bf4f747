"""Compare registered queries with their SQL on one scale: ``python tests/oracle_check.py [dir] [names]``."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DEFAULT_DIR = "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, connection, name: str, sf_dir: str) -> tuple[str, int, float]:
    """Status of one query, its rows and seconds."""
    from __spark_entry__ import oracle_sql, queries

    start = time.time()
    frame = queries()[name](spark, sf_dir)
    rows = frame.collect()
    seconds = time.time() - start
    sql = oracle_sql().get(name)
    if sql is None:
        return ("rows-only" if rows else "EMPTY"), len(rows), seconds
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    wanted = result.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"COLUMNS {sorted(columns)} / {sorted(frame.columns)}", len(rows), seconds
    ours, theirs = lines(frame.columns, rows), lines(columns, wanted)
    if ours == theirs:
        return "ok", len(rows), seconds
    difference = [x for x in ours if x not in set(theirs)][:3], [x for x in theirs if x not in set(ours)][:3]
    return f"DIFFERS {len(ours)}/{len(theirs)} {difference}", len(rows), seconds


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    from __spark_entry__ import queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else DEFAULT_DIR
    chosen = sys.argv[2:] or list(queries())
    spark, connection = session(), connect(sf_dir)
    bad = 0
    for name in chosen:
        try:
            status, rows, seconds = compare(spark, connection, name, sf_dir)
        except Exception as problem:
            status, rows, seconds = f"ERROR {type(problem).__name__}: {str(problem)[:600]}", 0, 0.0
        bad += status not in ("ok", "rows-only")
        print(f"{name:24s} {rows:7d} rows {seconds:7.2f} s  {status}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad", flush=True)
    spark.stop()
    sys.exit(min(bad, 1))
