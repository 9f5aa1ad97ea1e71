"""Run a registered query in Spark and its SQL in DuckDB, and compare all values.

Command line: ``python -m tests.oracle [sf] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if type(value).__name__ == "Decimal":
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in records]
    return sorted(columns), sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def compare(spark, con, name, fn, sql, sf) -> str:
    """Empty if equal, else what differs."""
    got = fn(spark, sf)
    columns, rows = rows_of(got.columns, [tuple(r) for r in got.collect()])
    if sql is None:
        return "" if rows else "no rows"
    want = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in want.description}
    simple = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    other = {n: (t, kinds.get(n)) for n, t in got.dtypes if simple.get(t) != kinds.get(n)}
    if other:
        return f"types differ: {other}"
    want_columns, want_rows = rows_of([d[0] for d in want.description], want.fetchall())
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    if len(rows) != len(want_rows):
        return f"{len(rows)} rows != {len(want_rows)}"
    bad = [(a, b) for a, b in zip(rows, want_rows) if a != b]
    return f"{len(bad)} of {len(rows)} rows differ, first {bad[0]}" if bad else ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from normatile.session import local_session

    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(sf)
    failed = 0
    sqls = oracle_sql()
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        kind = "sql " if name in sqls else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name} {time.time() - start:.2f}s {problem}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
