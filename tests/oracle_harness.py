"""Run registered queries next to their checking SQL and compare values."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb

from ledgerloom.sources.archive import PARQUET


def connect(folder: str):
    con = duckdb.connect()
    for name in PARQUET:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, folder, name, queries, oracles):
    """Return (ok, message)."""
    start = time.time()
    df = queries[name](spark, folder)
    got = df.collect()
    took = time.time() - start
    if name not in oracles:
        return True, f"{len(got)} rows, no oracle, {took:.2f}s"
    result = con.execute(oracles[name])
    want_columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(want_columns):
        return False, f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    left, right = rows_of(df.columns, got), rows_of(want_columns, want)
    if left == right:
        return bool(left), f"{len(left)} rows, {took:.2f}s"
    only_left = sorted(set(left) - set(right))[:3]
    only_right = sorted(set(right) - set(left))[:3]
    return False, f"{len(left)} vs {len(right)} rows {sorted(df.columns)}\n  spark {only_left}\n  check {only_right}"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry_module
    from ledgerloom.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    folder = "/root/testdata/sf0.01"
    con = connect(folder)
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, message = compare(spark, con, folder, name, queries, oracles)
        except Exception as exc:  # report and go on with the next query
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, message, flush=True)
    print("failures:", bad)
