"""Run registered queries against their oracle: row count, column names and values.

Usage: python tests/compare.py [sf dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, pd.Timestamp):
        return value.tz_localize(None).isoformat() if value.tzinfo else value.isoformat()
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10] if not hasattr(value, "hour") else value.isoformat()
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
        return int(value)
    return value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(normal(v) for v in row) for row in frame[columns].astype(object).values), key=repr)


def differences(spark_frame: pd.DataFrame, oracle_frame: pd.DataFrame) -> str | None:
    left, right = sorted(spark_frame.columns), sorted(oracle_frame.columns)
    if left != right:
        return f"columns differ: {left} / {right}"
    a, b = rows_of(spark_frame), rows_of(oracle_frame)
    if a == b:
        return None
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return f"rows {len(a)} / {len(b)}; columns {left}; only spark {only_a}; only oracle {only_b}"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir).toPandas()
            spent = time.time() - start
            start = time.time()
            if name not in oracles:
                print(f"{name}: rows only {len(frame)} ({spent:.1f}s)", flush=True)
                continue
            problem = differences(frame, con.execute(oracles[name]).df())
            status = "ok" if problem is None else f"DIFFERS {problem}"
            print(f"{name}: {len(frame)} rows {status} ({spent:.1f}s, oracle {time.time() - start:.1f}s)", flush=True)
            bad += problem is not None
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {type(error).__name__} {str(error)[:600]}", flush=True)
    print(f"{bad} bad", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
