"""Row predicates shared by every report."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.timerange import TimeRange, naive_utc


@dataclass(frozen=True)
class RequestFilter:
    """Optional conditions, all of which must hold; an empty text means no condition."""

    host: str | None = None
    remote_ip: str | None = None
    method: str | None = None
    status_class: str | None = None
    path: str | None = None
    country_code: str | None = None


def instant(df: DataFrame, moment: datetime, column: str = "ts") -> Column:
    """A literal of the same timestamp type as ``column``, so that comparing needs no
    cast on the column and the predicate reaches the Parquet scan."""
    text = naive_utc(moment).isoformat(sep=" ")
    kind = df.schema[column].dataType.simpleString()
    return F.expr(f"{'TIMESTAMP_NTZ' if kind == 'timestamp_ntz' else 'TIMESTAMP'} '{text}'")


def in_range(df: DataFrame, tr: TimeRange, column: str = "ts") -> Column:
    return F.col(column).between(instant(df, tr.start, column), instant(df, tr.end, column))


def on_days(df: DataFrame, start: datetime, end: datetime) -> Column:
    """The days of a range where a table is stored by ``date``, so that others are not opened."""
    if "date" not in df.columns:
        return F.lit(True)
    return F.col("date").between(F.lit(naive_utc(start).date()), F.lit(naive_utc(end).date()))


def within(df: DataFrame, tr: TimeRange) -> DataFrame:
    """The rows of the range, both ends included."""
    return df.filter(in_range(df, tr) & on_days(df, tr.start, tr.end))


def field_conditions(f: RequestFilter | None) -> list[Column]:
    if f is None:
        return []
    found = []
    if f.host:
        found.append(F.col("host") == f.host)
    if f.remote_ip:
        found.append(F.col("remote_ip") == f.remote_ip)
    if f.method:
        found.append(F.col("method") == f.method.upper())
    if f.status_class:
        found.append(F.col("status_class") == f.status_class)
    if f.path:
        # "%" and "_" in the given text stay wildcards; a backslash is an ordinary character.
        found.append(F.col("path").like("%" + f.path.replace("\\", "\\\\") + "%"))
    if f.country_code:
        found.append(F.col("country_code") == f.country_code.upper())
    return found


def filter_requests(requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None) -> DataFrame:
    """Rows of the range that satisfy the filter.

    A table stored with a ``date`` partition column is pruned to the days of the range.
    """
    rows = within(requests, tr)
    return rows.filter(reduce(lambda a, b: a & b, field_conditions(f), F.lit(True)))


def live_conditions(f: RequestFilter) -> Column:
    """The live-feed predicate: like the report filter, but every comparison is verbatim
    and the path condition is plain containment."""
    found = [
        F.col(name) == value
        for name, value in (
            ("host", f.host),
            ("remote_ip", f.remote_ip),
            ("method", f.method),
            ("status_class", f.status_class),
            ("country_code", f.country_code),
        )
        if value
    ]
    if f.path:
        found.append(F.col("path").contains(f.path))
    return reduce(lambda a, b: a & b, found, F.lit(True))


def stream_filter(requests: DataFrame, f: RequestFilter) -> DataFrame:
    """The live feed reduced to the rows a viewer asked for (batch or streaming)."""
    return requests.filter(live_conditions(f))
