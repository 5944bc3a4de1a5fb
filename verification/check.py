"""Compare queries with their SQL: python -m verification.check [--sf DIR] [--spark-only] [name ...]"""

import argparse
import math
import os
import time

import duckdb
from pyspark.sql import SparkSession

from verification.registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName("claimweir")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, list | tuple):
        return tuple(_plain(v) for v in value)
    if isinstance(value, float) and math.isfinite(value):
        return float(f"{value:.12g}")
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, sf_dir, name):
    started = time.time()
    frame = QUERIES[name](spark, sf_dir)
    got = frame.collect()
    took = time.time() - started
    if name not in ORACLES:
        return True, took, 0.0, f"{len(got)} rows, no SQL"
    started = time.time()
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    sql_took = time.time() - started
    if sorted(columns) != sorted(frame.columns):
        return False, took, sql_took, f"columns {sorted(frame.columns)} != {sorted(columns)}"
    ours, theirs = _rows(frame.columns, got), _rows(columns, want)
    if ours == theirs:
        return True, took, sql_took, f"{len(got)} rows"
    extra = [r for r in ours if r not in set(theirs)][:2]
    missing = [r for r in theirs if r not in set(ours)][:2]
    return False, took, sql_took, f"{len(got)} rows against {len(want)}\n   spark {extra}\n   sql   {missing}"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    spark, con = session(), duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{options.sf}/{table}.parquet'")
    failed = 0
    for name in options.names or QUERIES:
        try:
            ok, took, sql_took, note = compare(spark, con, options.sf, name)
        except Exception as error:  # keep going: the report lists every failure
            ok, took, sql_took, note = False, 0.0, 0.0, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:36} spark {took:6.2f}s sql {sql_took:6.2f}s  {note}", flush=True)
    print(f"{failed} failed")
    spark.stop()


if __name__ == "__main__":
    main()
