"""Run queries against their SQL on one scale factor: python tests/oracle_compare.py [sf_dir] [names…]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, int]:
    frame = queries()[name](spark, sf_dir)
    columns, ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return ("rows only" if ours else "EMPTY"), len(ours)
    result = con.execute(sql)
    names, theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if columns != names:
        return f"COLUMNS {columns} / {names}", len(ours)
    if ours != theirs:
        pairs = [(a, b) for a, b in zip(ours, theirs) if a != b][:3]
        return f"DIFFERENT {len(ours)} / {len(theirs)} rows, first {pairs}", len(ours)
    return "ok", len(ours)


def main() -> None:
    from conftest import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf_dir)
    for name in sys.argv[2:] or queries():
        begun = time.time()
        try:
            outcome, count = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            outcome, count = f"ERROR {str(error)[:600]}", 0
        print(f"{name:26s} {count:8d} rows {time.time() - begun:6.2f}s  {outcome}", flush=True)


if __name__ == "__main__":
    main()
