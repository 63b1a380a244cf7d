"""Listing and looking up stored rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.filters import RequestFilter, filter_requests, within
from loglens.functions.fixed_values import PAGE_COLUMNS, SORTABLE_COLUMNS
from loglens.functions import measures as m
from loglens.timerange import TimeRange


def _order(column: str, direction: str) -> list[Column]:
    """NULLs last either way; the id decides between equal rows."""
    chosen = column if column in SORTABLE_COLUMNS else "ts"
    by = F.desc_nulls_last if direction.lower() == "desc" else F.asc_nulls_last
    return [by(chosen), F.asc("id")]


def requests_page(
    requests: DataFrame,
    tr: TimeRange,
    f: RequestFilter | None = None,
    *,
    offset: int = 0,
    limit: int = 100,
    sort_by: str = "ts",
    sort_dir: str = "desc",
) -> DataFrame:
    """One page of the matching requests."""
    rows = filter_requests(requests, tr, f)
    columns = [c for c in PAGE_COLUMNS if c in rows.columns]
    return rows.select(*columns).orderBy(*_order(sort_by, sort_dir)).offset(offset).limit(limit)


def requests_total(requests: DataFrame, tr: TimeRange, f: RequestFilter | None = None) -> DataFrame:
    """The number of requests that ``requests_page`` pages through."""
    return filter_requests(requests, tr, f).agg(m.requests().alias("total"))


def request_by_id(requests: DataFrame, request_id: int) -> DataFrame:
    return requests.filter(F.col("id") == request_id)


def requests_by_ids(requests: DataFrame, ids: DataFrame) -> DataFrame:
    """The requests whose id is listed in ``ids``."""
    return requests.join(ids.select("id").distinct(), "id", "left_semi")


def _days(requests: DataFrame) -> list[str]:
    """The days that a table stored by day has files of, newest first; none where it is not stored so."""
    if "date" not in requests.columns:
        return []
    found = (re.search(r"/date=(\d{4}-\d{2}-\d{2})/", file) for file in requests.inputFiles())
    return sorted({day.group(1) for day in found if day}, reverse=True)


def recent_requests(requests: DataFrame, tr: TimeRange | None = None, *, limit: int = 100) -> DataFrame:
    """The newest requests; a range bounds what is read to find them.

    Of a table stored by day (with its column ``date``) only the newest days are read that hold ``limit`` rows.
    """
    rows = within(requests, tr) if tr else requests
    found = 0
    for day in _days(requests):
        found += rows.filter(F.col("date") == F.lit(day).cast("date")).limit(limit - found).count()
        if found >= limit:
            rows = rows.filter(F.col("date") >= F.lit(day).cast("date"))
            break
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def _event_rows(events: DataFrame, tr: TimeRange, **equal: str | None) -> DataFrame:
    rows = within(events, tr)
    for column, value in equal.items():
        if value:
            rows = rows.filter(F.col(column) == value)
    return rows


def security_events_page(
    events: DataFrame,
    tr: TimeRange,
    *,
    host: str | None = None,
    remote_ip: str | None = None,
    event_type: str | None = None,
    severity: str | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """One page of the matching events, newest first, with readable details."""
    rows = _event_rows(events, tr, host=host, remote_ip=remote_ip, event_type=event_type, severity=severity)
    page = rows.orderBy(F.desc("ts"), F.asc("event_type"), F.asc("id")).offset(offset).limit(limit)
    details = F.coalesce(F.from_json("details", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return page.withColumn("details", details)


def security_events_total(events: DataFrame, tr: TimeRange, **equal: str | None) -> DataFrame:
    return _event_rows(events, tr, **equal).agg(m.requests().alias("total"))


def security_event_by_id(events: DataFrame, event_id: int) -> DataFrame:
    return events.filter(F.col("id") == event_id)
