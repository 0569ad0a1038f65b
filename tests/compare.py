"""Runs queries on Spark and their SQL on DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(item) for item in value])
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in data)


def differences(spark, con, name, function, sql, sf):
    """None when Spark and DuckDB agree, else a short account; and the number of rows."""
    frame = function(spark, sf)
    got_names = frame.columns
    got = [tuple(row) for row in frame.collect()]
    if sql is None:
        return (None if got else "no rows"), len(got)
    result = con.execute(sql)
    want_names = [column[0] for column in result.description]
    want = result.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}", len(got)
    types = {c[0]: str(c[1]) for c in result.description}
    a, b = rows(got_names, got), rows(want_names, want)
    kinds = []
    for field in frame.schema.fields:
        spark_kind, duck_kind = field.dataType.simpleString(), types[field.name]
        pair = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
        if pair.get(spark_kind) != duck_kind:
            kinds.append(f"{field.name}: {spark_kind} / {duck_kind}")
    note = f" [types differ: {kinds}]" if kinds else ""
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a = [r for r in a if r not in in_b][:2]
        only_b = [r for r in b if r not in in_a][:2]
        return f"{len(a)} vs {len(b)} rows; spark {only_a}; sql {only_b}{note}"[:1500], len(got)
    if kinds:
        return note.strip(), len(got)
    return None, len(got)


def main() -> None:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from quillrank.session import local_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("sf"):
        sf = f"/root/testdata/{args.pop(0)}"
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem, count = differences(spark, con, name, queries[name], oracle.get(name), sf)
        except Exception as error:  # noqa: BLE001
            problem, count = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        kind = "" if name in oracle else " (rows only)"
        print(f"{mark} {name}{kind} rows={count} {time.time() - start:.1f}s" + (f"\n     {problem}" if problem else ""), flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")


if __name__ == "__main__":
    main()
