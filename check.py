"""Run registered queries and compare each with its SQL counterpart.

    python check.py [--sf 0.01] [--show] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from spanforge.plans.oracle import oracle_sql
from spanforge.plans.queries import queries
from spanforge.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return str(value)


def table_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(df, con: duckdb.DuckDBPyConnection, text: str) -> str | None:
    """None when both sides agree, else what differs."""
    rows = [tuple(r) for r in df.collect()]
    result = con.execute(text)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows and {len(expected)}"
    mine, theirs = table_of(df.columns, rows), table_of(names, expected)
    for a, b in zip(mine, theirs):
        if a != b:
            return f"first difference {a} and {b}"
    return None


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--show", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session()
    sf_dir = f"/root/testdata/sf{args.sf}"
    con, texts = connect(sf_dir), oracle_sql()
    failed = 0
    for name, run in queries().items():
        if args.names and name not in args.names:
            continue
        begun = time.time()
        try:
            df = run(spark, sf_dir)
            if name in texts:
                outcome = compare(df, con, texts[name]) or "same"
            else:
                outcome = f"no counterpart, {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            outcome = "error " + str(error).split("JVM stacktrace")[0][:700]
        bad = outcome != "same" and not outcome.startswith("no counterpart")
        failed += bad
        print(f"{'!!' if bad else 'ok'} {name:28s} {time.time() - begun:6.1f}s {outcome[:900]}",
              flush=True)
        if args.show:
            df.show(5, truncate=60)
    print(f"{failed} differ")


if __name__ == "__main__":
    main()
