"""Runs a registered query and its SQL side by side. ``python tests/compare.py [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET threads TO 8")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _key(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(columns, rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir: str, name: str, query, sql: str) -> str | None:
    """None when equal, else what differs."""
    table = query(spark, sf_dir).toArrow()
    got_columns = table.column_names
    got = [tuple(r.values()) for r in table.to_pylist()]
    result = connection.execute(sql)
    want_columns = [d[0] for d in result.description]
    want_types = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    arrow_types = {f.name: str(f.type) for f in table.schema}
    names = {"int32": "INTEGER", "int64": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
             "date32[day]": "DATE", "bool": "BOOLEAN"}
    for column, kind in arrow_types.items():
        if names.get(kind, kind) != want_types[column]:
            return f"type of {column}: {kind} != {want_types[column]}"
    a, b = rows_of(got_columns, got), rows_of(want_columns, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, {sorted(got_columns)}: {bad[0][0]} != {bad[0][1]}"
    return f"empty" if not a else None


def main(names: list[str]) -> int:
    import __spark_entry__ as entry
    from loanframe.session import get_session

    spark = get_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = os.environ.get("COMPARE_SF_DIR", "/root/testdata/sf0.01")
    connection = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracle:
                outcome = compare(spark, connection, sf_dir, name, query, oracle[name])
            else:
                outcome = None if query(spark, sf_dir).toArrow().num_rows else "empty"
        except Exception as error:  # report and go on to the next query
            outcome = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += outcome is not None
        kind = "" if name in oracle else " (rows only)"
        print(f"{name}{kind}: {outcome or 'ok'} [{time.time() - start:.1f}s]", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
