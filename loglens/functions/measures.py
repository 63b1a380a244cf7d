"""Aggregate expressions that several reports share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def requests() -> Column:
    return F.count(F.lit(1))


def class_counts(top: int | None = None) -> dict[str, Column]:
    """Requests by status class; the last class is open-ended unless ``top`` closes it."""
    status = F.col("status")
    server_errors = status >= 500 if top is None else status.between(500, top)
    return {
        "req_2xx": count_if(status.between(200, 299)),
        "req_3xx": count_if(status.between(300, 399)),
        "req_4xx": count_if(status.between(400, 499)),
        "req_5xx": count_if(server_errors),
    }


def errors() -> Column:
    return count_if(F.col("status") >= 400)


def bytes_out() -> Column:
    return F.coalesce(F.sum("response_bytes"), F.lit(0))


def bytes_in() -> Column:
    return F.coalesce(F.sum("request_bytes"), F.lit(0))


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """part / whole, rounded half-even; 0 when there is nothing to divide by."""
    return F.when(whole > 0, F.bround(part / whole, digits)).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part of whole in percent, rounded half-even; 0 when there is nothing to divide by."""
    return F.when(whole > 0, F.bround(part / whole * 100, digits)).otherwise(F.lit(0.0))


def error_rate(digits: int) -> Column:
    """Share of requests with status >= 400; a missing status is no error."""
    return ratio(errors(), requests(), digits)


def named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def whole_ms(value: Column) -> Column:
    """Interpolated milliseconds cut to a whole number, 0 when missing."""
    return F.coalesce(F.round(value, 6).cast("int"), F.lit(0))


def nearest_ms(value: Column) -> Column:
    """Interpolated milliseconds rounded half-even to a whole number."""
    return F.rint(F.round(value, 6)).cast("int")
