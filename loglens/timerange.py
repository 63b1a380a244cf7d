"""Time ranges of a report: a named look-back period or one local calendar day."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from loglens.functions.fixed_values import DEFAULT_PERIOD, PERIODS


@dataclass(frozen=True)
class TimeRange:
    """Both ends belong to the range; instants are naive UTC."""

    start: datetime
    end: datetime
    bucket: str = "1 hour"
    granularity: str = "hour"


def naive_utc(moment: datetime) -> datetime:
    if moment.tzinfo is None:
        return moment
    return moment.astimezone(timezone.utc).replace(tzinfo=None)


def resolve_time_range(now: datetime, period: str | None = None, date: str | None = None) -> TimeRange:
    """The range of ``date`` (ISO-8601 with offset, 24 h from that instant), else of ``period``.

    An unreadable date falls back to the period, an unknown period to the last 24 hours.
    """
    if date:
        try:
            start = naive_utc(datetime.fromisoformat(date))
            return TimeRange(start, start + timedelta(hours=24), "1 hour", "hour")
        except (ValueError, OverflowError):
            pass
    minutes, bucket, granularity = PERIODS.get(period or DEFAULT_PERIOD, PERIODS[DEFAULT_PERIOD])
    end = naive_utc(now)
    return TimeRange(end - timedelta(minutes=minutes), end, bucket, granularity)
