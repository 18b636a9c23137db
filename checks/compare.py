"""Runs registered queries in Spark and their oracles in DuckDB and compares the rows."""

from __future__ import annotations

import math
import signal
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import load
from checks.views import BASE_TABLES, Views


# A query that takes longer than this on the small tables is reported as failed.
LIMIT_S = 30


def _cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"f{value:.9g}"
    if isinstance(value, int):
        return f"i{value}"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[int, str]:
    """Row count of the Spark result and an error text, empty when both agree."""
    registry = load()
    df = registry.QUERIES[name](Views(spark, sf_dir))
    got = rows_of(df.columns, df.collect())
    if name not in registry.ORACLES:
        return len(got), ""
    cursor = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(columns)}"
    want = rows_of(columns, cursor.fetchall())
    if got == want:
        return len(got), ""
    extra = sorted(set(got) - set(want))[:2]
    lacking = sorted(set(want) - set(got))[:2]
    return len(got), f"{len(got)} != {len(want)} rows; {sorted(columns)}\n   spark {extra}\n   duck  {lacking}"


def _expire(signum, frame):
    raise TimeoutError("too slow")


def main(sf_dir: str, patterns: list[str]) -> None:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    names = [n for n in load().QUERIES if not patterns or any(p in n for p in patterns)]
    bad = 0
    signal.signal(signal.SIGALRM, _expire)
    for name in names:
        started = time.time()
        signal.alarm(LIMIT_S)
        try:
            n, error = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on
            n, error = -1, f"{type(e).__name__}: {str(e)[:700]}"
        signal.alarm(0)
        bad += bool(error)
        oracle = "oracle" if name in load().ORACLES else "rows"
        print(f"{'FAIL' if error else 'ok  '} {name} {n} {oracle} {time.time() - started:.1f}s {error}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
