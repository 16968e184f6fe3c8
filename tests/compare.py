"""Compare registered queries with their SQL on DuckDB: ``python tests/compare.py [sf] [key prefix ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
KINDS = {
    "bigint": "int", "integer": "int", "int": "int", "double": "float", "varchar": "text", "string": "text",
    "date": "date", "boolean": "bool", "bool": "bool",
}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, list):
        return tuple(normal(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    rel = con.sql(sql)
    names, types = list(rel.columns), [str(t).lower() for t in rel.types]
    expected = rows_of(names, rel.fetchall())
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    spark_types = dict(df.dtypes)
    for name, kind in zip(names, types):
        if KINDS.get(kind, kind) != KINDS.get(spark_types[name], spark_types[name]):
            return f"type of {name}: {spark_types[name]} != {kind}"
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else "ok"


def main() -> int:
    import __spark_entry__ as entry
    from ratesift.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    folder = f"/root/testdata/sf{sf}"
    spark = get_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                        spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, failed = connect(folder), entry.oracle_sql(), 0
    for key, plan in entry.queries().items():
        if prefixes and not key.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = plan(spark, folder)
            verdict = compare(df, con, sqls[key]) if key in sqls else f"rows-only {df.count()}"
        except Exception as error:  # report and go on to the next query
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += not verdict.startswith(("ok", "rows-only"))
        print(f"{key:34s} {time.time() - start:6.2f}s {verdict}", flush=True)
        spark.catalog.clearCache()
    return failed


if __name__ == "__main__":
    sys.exit(main())
