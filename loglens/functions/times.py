"""Timestamps as integers and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 (the session runs in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_unix_seconds(seconds: Column) -> Column:
    """Unix seconds with fraction to a timestamp, rounded to the microsecond."""
    return F.timestamp_micros(F.rint(seconds * F.lit(1e6)).cast("bigint"))


def bucket_start(ts: Column, width: str) -> Column:
    """Start of the tumbling window of ``width`` that holds ``ts``."""
    return F.window(ts, width)["start"]


def sunday_first_weekday(ts: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(ts) - 1
