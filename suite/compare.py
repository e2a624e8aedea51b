"""Run registered queries next to their SQL in DuckDB and report differences.

    python -m suite.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from gridloom.session import local_session

from .registry import ORACLE, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value) -> str:
    if value is None:
        return "<null>"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, float):
        return "<nan>" if math.isnan(value) else f"f:{value!r}"
    return f"{type(value).__name__}:{value!r}"


def canonical(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str) -> str:
    """"" when both agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        return "" if mine else "no rows"
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    if not mine:
        return "both empty"
    a, b = canonical(df.columns, mine), canonical(columns, theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return "" if not bad else f"{len(bad)} rows differ, first {bad[0]}"


def main() -> None:
    from . import load_all

    load_all()
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    names = [n for n in QUERIES if not wanted or any(n.startswith(w) for w in wanted)]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        note = "" if name in ORACLE else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s{note} {problem}", flush=True)
    print(f"{len(names) - failed}/{len(names)} agree")


if __name__ == "__main__":
    main()
