"""Run registered queries and their SQL side by side: ``python -m tests.harness sf0.01 [names]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

DATA = os.environ.get("TEST_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, connection, name: str, folder: str):
    """(ok, message) of one query."""
    from tidings.plans import ORACLES, QUERIES

    start = time.time()
    frame = QUERIES[name](spark, folder)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    took = time.time() - start
    if name not in ORACLES:
        return True, f"{len(got[1])} rows (no SQL) {took:.1f}s"
    start = time.time()
    cursor = connection.execute(ORACLES[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    sql_took = time.time() - start
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:3] if len(got[1]) < 50000 else []
        missing = [r for r in want[1] if r not in set(got[1])][:3] if len(want[1]) < 50000 else []
        return False, f"rows {len(got[1])} vs {len(want[1])}\n   spark only {str(extra)[:700]}\n   sql only   {str(missing)[:700]}"
    return True, f"{len(got[1])} rows {took:.1f}s / {sql_took:.1f}s"


def main(scale: str, names: list[str]) -> int:
    from tidings.plans import QUERIES
    from tidings.session import build_session

    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"{DATA}/{scale}"
    connection = connect(folder)
    bad = 0
    for name in names or list(QUERIES):
        try:
            ok, message = compare(spark, connection, name, folder)
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, message, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
