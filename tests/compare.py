"""Compare registered queries with their SQL in DuckDB, row by row.

Run as a script: python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _sort_key(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def difference(df, con, sql: str) -> str | None:
    """None when both sides hold the same columns and rows, else what differs."""
    names = sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_sort_key)
    done = con.execute(sql)
    described = {d[0]: str(d[1]) for d in done.description}
    rows = done.fetchall()
    if sorted(described) != names:
        return f"columns {names} != {sorted(described)}"
    spark_types = {n: TYPES.get(t, t) for n, t in df.dtypes}
    wrong = {n: (spark_types[n], described[n]) for n in names if spark_types[n] != described[n]}
    order = [list(described).index(n) for n in names]
    want = sorted((tuple(r[i] for i in order) for r in rows), key=_sort_key)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if not all(_same(x, y) for x, y in zip(a, b)):
            bad = sum(not all(_same(x, y) for x, y in zip(p, q)) for p, q in zip(got, want))
            return f"{bad} of {len(got)} rows differ, first {dict(zip(names, a))} != {dict(zip(names, b))}"
    return f"types {wrong}" if wrong else None


def _same(x, y) -> bool:
    if isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y):
        return True
    return x == y


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from tenura.session import build_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = oracle_sql()
    failed = 0
    for name, build in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            note = difference(df, con, oracles[name]) if name in oracles else f"rows only: {df.count()}"
        except Exception as e:  # report and go on
            note = f"ERROR {str(e)[:600]}"
        bad = note is not None and not note.startswith("rows only")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {time.time() - start:6.2f}s {name} {note or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
