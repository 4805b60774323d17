"""Compare every query with its SQL twin in an in-process DuckDB.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _sortable(row: tuple) -> tuple:
    return tuple((v is None, type(v).__name__, str(v)) for v in row)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=_sortable)


def differences(spark_cols, spark_rows, sql_cols, sql_rows) -> str | None:
    if sorted(spark_cols) != sorted(sql_cols):
        return f"columns {sorted(spark_cols)} / {sorted(sql_cols)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} / {len(sql_rows)}"
    a, b = rows_of(spark_cols, spark_rows), rows_of(sql_cols, sql_rows)
    for x, y in zip(a, b, strict=True):
        for v, w in zip(x, y, strict=True):
            same = v == w and type(v) is type(w)
            if not same and isinstance(v, float) and isinstance(w, float):
                same = math.isnan(v) and math.isnan(w)
            if not same:
                return f"{x} / {y}"
    return None


def check(spark, con, sf_dir: str, name: str, query, sql: str) -> str | None:
    df = query(spark, sf_dir)
    found = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return differences(df.columns, found, names, cursor.fetchall())


def main() -> int:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = set(args[1:])
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    sqls = oracle_sql()
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        if name not in sqls:
            print(f"skip {name}: no SQL")
            continue
        start = time.time()
        try:
            result = check(spark, con, sf_dir, name, query, sqls[name])
        except Exception as e:  # report and go on to the next query
            result = f"{type(e).__name__}: {str(e)[:600]}"
        failed += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.2f}s {result or ''}")
    print(f"{failed} failed; unmatched SQL: {sorted(set(sqls) - set(queries()))}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
