"""Web access-log analytics and threat detection as Spark DataFrame jobs.

Every operator is a function from DataFrames to a DataFrame; nothing here holds
session state and "now" is always an argument.
"""

from loglens.filters import RequestFilter, filter_requests
from loglens.timerange import TimeRange, resolve_time_range

__all__ = ["RequestFilter", "TimeRange", "filter_requests", "resolve_time_range"]
