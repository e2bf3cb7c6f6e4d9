"""Compare registered queries with their SQL twin.  ``python tests/parity.py [sf] [name-prefix ...]``"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()[:26]
    return "null" if v is None else str(v)


def normalise(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql, clock=None):
    start = time.time()
    df = fn(spark, sf_dir)
    built = time.time()
    rows = df.collect()
    if clock is not None:
        clock.update(build=built - start, run=time.time() - built)
    spark_names, spark_rows = normalise(df.columns, [tuple(r) for r in rows])
    if sql is None:
        return len(spark_rows), None
    got = con.sql(sql)
    sql_names, sql_rows = normalise(got.columns, got.fetchall())
    if spark_names != sql_names:
        return len(spark_rows), f"columns {spark_names} != {sql_names}"
    if len(spark_rows) != len(sql_rows):
        return len(spark_rows), f"rows {len(spark_rows)} != {len(sql_rows)}"
    bad = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    return len(spark_rows), f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def session(app="parity"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    import __spark_entry__ as entry

    sf = argv[0] if argv and argv[0].replace(".", "").isdigit() else "0.01"
    prefixes = [a for a in argv if not a.replace(".", "").isdigit()]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            clock = {}
            n, problem = compare(spark, con, sf_dir, name, fn, oracles.get(name), clock)
        except Exception as e:  # report and go on with the next query
            n, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        took = time.time() - start
        mark = "FAIL" if problem else ("ok" if name in oracles else "rows")
        parts = " ".join(f"{k}={v:.2f}" for k, v in clock.items())
        print(f"{mark:5} {name:32} rows={n:<8} {took:6.2f}s {parts} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
