"""Runs registered queries in Spark and in DuckDB and compares the rows.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def canonical(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return v if isinstance(v, (str, bool, type(None))) else repr(v)

    return Counter(tuple(value(row[i]) for i in order) for row in rows)


def spark_rows(df) -> Counter:
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(connection, sql: str) -> Counter:
    connection.execute(sql)
    columns = [d[0] for d in connection.description]
    return canonical(columns, connection.fetchall())


def main() -> None:
    import __spark_entry__ as entry
    from kindred.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, queries = duck(sf_dir), entry.oracle_sql(), entry.queries()
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            ours = spark_rows(df)
        except Exception as error:  # report and go on with the next query
            print(f"{name:24s} ERROR {str(error)[:600]}", flush=True)
            continue
        seconds = time.time() - start
        if name not in oracles:
            print(f"{name:24s} rows {sum(ours.values()):8d}  {seconds:6.2f}s  no SQL", flush=True)
            continue
        start = time.time()
        try:
            theirs = duck_rows(connection, oracles[name])
        except duckdb.Error as error:
            print(f"{name:24s} SQL ERROR {str(error)[:600]}", flush=True)
            continue
        verdict = "ok" if ours == theirs else "DIFFERENT"
        extra = ""
        if ours != theirs:
            extra = f" only spark {list((ours - theirs).items())[:3]} only sql {list((theirs - ours).items())[:3]}"
        print(
            f"{name:24s} rows {sum(ours.values()):8d} / {sum(theirs.values()):8d}  {seconds:6.2f}s  "
            f"sql {time.time() - start:5.2f}s {verdict}{extra}",
            flush=True,
        )


if __name__ == "__main__":
    main()
