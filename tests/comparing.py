"""Comparing a Spark result with the result of its DuckDB SQL."""

from __future__ import annotations

import math
from datetime import date, datetime
from pathlib import Path

import duckdb


def duckdb_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return str(value)


def as_rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return names, sorted(plain, key=repr)


def differences(spark_df, connection, sql: str) -> str | None:
    """None when both give the same columns and rows, else the first difference."""
    got_names, got = as_rows(spark_df.columns, spark_df.collect())
    found = connection.execute(sql)
    want_names, want = as_rows([d[0] for d in found.description], found.fetchall())
    if got_names != want_names:
        return f"columns {got_names} instead of {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}"
    for mine, theirs in zip(got, want):
        if mine != theirs:
            return f"got {mine} instead of {theirs} in {got_names}"
    return None
