"""Run registered queries and their SQL twins side by side.

    python -m tests.compare [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duckdb_views(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return float(value)
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark_df, connection, sql: str) -> tuple[int, Counter, Counter]:
    """Row count of the Spark result, and the rows only one of the two engines has."""
    relation = connection.execute(sql)
    columns = [d[0] for d in relation.description]
    if sorted(columns) != sorted(spark_df.columns):
        raise AssertionError(f"columns differ: {sorted(spark_df.columns)} / {sorted(columns)}")
    expected = _bag(columns, relation.fetchall())
    actual = _bag(spark_df.columns, spark_df.collect())
    return sum(actual.values()), actual - expected, expected - actual


def main(folder: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, twins, failed = duckdb_views(folder), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in twins:
                rows, extra, missing = differences(df, connection, twins[name])
                state = "ok" if not extra and not missing else f"DIFF +{sum(extra.values())} -{sum(missing.values())}"
                if state != "ok":
                    failed += 1
                    print("   spark:", list(extra)[:2], "\n   sql:  ", list(missing)[:2])
            else:
                rows, state = len(df.collect()), "rows only"
        except Exception as error:  # noqa: BLE001 - report and go on
            failed += 1
            rows, state = -1, f"ERROR {type(error).__name__}: {str(error)[:1200]}"
        print(f"{name:28s} {rows:8d} {time.time() - start:7.2f}s {state}", flush=True)
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:]
    sys.exit(main(arguments[0] if arguments else "/root/testdata/sf0.01", arguments[1:]))
