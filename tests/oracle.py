"""Compare registered queries with their SQL: python tests/oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return (1, "")
    if isinstance(value, bool):
        return (0, value)
    if hasattr(value, "isoformat"):
        return (0, value.isoformat()[:10])
    return (0, value)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in records)


def compare(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    expected = rows(names, cursor.fetchall())
    actual = rows(df.columns, [tuple(r) for r in df.collect()])
    if len(actual) != len(expected):
        return f"{len(actual)} rows != {len(expected)}"
    for a, b in zip(actual, expected):
        if a != b:
            return f"first difference\n  spark  {a}\n  duckdb {b}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
    sql_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    odd = [(c, t, sql_types[c]) for c, t in df.dtypes if kinds.get(t) != sql_types[c]]
    return f"types {odd}" if odd else None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from contagrid.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), oracle_sql(), 0
    for name, make in queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            result = compare(make(spark, sf_dir), con, sql[name]) if name in sql else "no SQL"
        except Exception as error:  # report and go on with the other queries
            result = f"{type(error).__name__}: {str(error)[:900]}"
        bad += result is not None
        print(f"{'ok  ' if result is None else 'DIFF'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
