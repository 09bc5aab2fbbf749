"""Run a registered query in Spark and its SQL in DuckDB and compare both results."""

from __future__ import annotations

from pathlib import Path

import duckdb

TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def spark_result(df):
    types = {name: TYPES[kind] for name, kind in df.dtypes}
    names = sorted(types)
    rows = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    return {n: types[n] for n in names}, rows


def duckdb_result(connection, sql):
    relation = connection.sql(sql)
    types = dict(zip(relation.columns, map(str, relation.types)))
    names = sorted(types)
    ordered = relation.select(", ".join(f'"{n}"' for n in names))
    return {n: types[n] for n in names}, sorted(ordered.fetchall(), key=repr)


def differences(spark_side, duckdb_side) -> str:
    (types, rows), (other_types, other_rows) = spark_side, duckdb_side
    if types != other_types:
        return f"columns differ: {types} against {other_types}"
    if len(rows) != len(other_rows):
        return f"{len(rows)} rows against {len(other_rows)}"
    wrong = [(a, b) for a, b in zip(rows, other_rows) if repr(a) != repr(b)]
    return f"{len(wrong)} rows differ, first: {wrong[0]}" if wrong else ""
