"""Grouped measures with exact percentiles and distinct counts, safe for hot groups.

A group may hold a large share of all rows, so rows are first reduced to one line per
(group, value) and per (group, distinct item) in a single scan. Spark combines these
before the shuffle and spreads a hot group over tasks by value. Only the value counts of a
group then meet in one task, where sorted windows stream them and may spill.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.functions.measures import requests as request_count

Position = Callable[[Column], Column]

_ROWS = "__rows"
_ITEM = "__item"
_VALUE = "__value"
_BY_VALUE = "__by_value"


def percentile(share: float) -> Position:
    """Zero-based, possibly fractional position of the interpolated percentile among n values."""
    return lambda n: F.lit(share) * (n - 1)


def upper_median(n: Column) -> Column:
    """Zero-based position of the middle value, the upper one when n is even."""
    return F.floor(n / 2).cast("double")


def read_positions(
    counts: DataFrame,
    keys: list[str],
    value: str,
    weight: str,
    positions: dict[str, Position],
    others: list[Column] = (),
) -> DataFrame:
    """Values at the given positions of each group's sorted multiset.

    ``counts`` holds each (keys, value) once, ``weight`` times; rows with a NULL value
    only take part in ``others``, aggregates computed on the way.
    """
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    weight_of = F.when(F.col(value).isNotNull(), F.col(weight)).otherwise(F.lit(0))
    up_to_here = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns(
        {
            "__weight": weight_of,
            "__end": F.sum(weight_of).over(up_to_here),
            "__total": F.sum(weight_of).over(group),
        }
    )

    def at(position: Column) -> Column:
        inside = (position < F.col("__end")) & (position >= F.col("__end") - F.col("__weight"))
        return F.max(F.when(inside, F.col(value)))

    picks = []
    for name, position in positions.items():
        spot = position(F.col("__total"))
        picks += [at(F.floor(spot)).alias(f"__{name}_low"), at(F.ceil(spot)).alias(f"__{name}_high")]
    picked = ranked.groupBy(*keys).agg(*others, *picks, F.max("__total").alias("__total"))

    def interpolate(name: str, position: Position) -> Column:
        spot = position(F.col("__total"))
        low, high = F.col(f"__{name}_low"), F.col(f"__{name}_high")
        return (low + (high - low) * (spot - F.floor(spot))).cast("double")

    kept = [c for c in picked.columns if not c.startswith("__")]
    return picked.select(*kept, *[interpolate(n, p).alias(n) for n, p in positions.items()])


def summarize(
    df: DataFrame,
    keys: list[str],
    totals: dict[str, Column],
    *,
    greatest: dict[str, Column] | None = None,
    distinct: tuple[str, str] | None = None,
    values: str | None = None,
    positions: dict[str, Position] | None = None,
) -> DataFrame:
    """One row per group.

    ``totals`` are counts or sums (they add up over parts of a group), ``greatest`` are
    columns whose maximum is wanted, ``distinct`` is (result name, column) and
    ``positions`` are read from the sorted ``values`` column.
    """
    greatest = greatest or {}
    parts = [c.alias(n) for n, c in totals.items()] + [F.max(c).alias(n) for n, c in greatest.items()]
    merged = [F.sum(n).alias(n) for n in totals] + [F.max(n).alias(n) for n in greatest]

    if not positions:
        counted = [F.count_distinct(distinct[1]).alias(distinct[0])] if distinct else []
        return df.groupBy(*keys).agg(*parts, *counted)

    df = df.withColumn(_VALUE, F.col(values))
    if not distinct:
        counts = df.groupBy(*keys, _VALUE).agg(request_count().alias(_ROWS), *parts)
        return read_positions(counts, keys, _VALUE, _ROWS, positions, merged)

    return finish(lines(df, keys, parts, distinct[1]), keys, list(totals), list(greatest), distinct[0], positions)


def lines(df: DataFrame, keys: list[str], parts: list[Column], item: str) -> DataFrame:
    """One line per (group, item) and one per (group, value), from one scan.

    Measures are complete over the value lines alone, which ``__by_value`` marks.
    """
    return (
        df.withColumn(_ITEM, F.col(item))
        .groupingSets([[*keys, _ITEM], [*keys, _VALUE]], *keys, _ITEM, _VALUE)
        .agg(F.grouping(_ITEM).alias(_BY_VALUE), request_count().alias(_ROWS), *parts)
    )


def finish(
    df: DataFrame,
    keys: list[str],
    totals: list[str],
    greatest: list[str],
    distinct_name: str,
    positions: dict[str, Position],
) -> DataFrame:
    """Lines to one row per group: item lines are counted, value lines added and ranked."""

    def of_values(column: str) -> Column:
        return F.when(F.col(_BY_VALUE) == 1, F.col(column))

    counts = df.groupBy(*keys, _VALUE).agg(
        F.sum(of_values(_ROWS)).alias(_ROWS),
        *[F.sum(of_values(n)).alias(n) for n in totals],
        *[F.max(of_values(n)).alias(n) for n in greatest],
        F.count(_ITEM).alias(distinct_name),
    )
    merged = [F.sum(n).alias(n) for n in [*totals, distinct_name]] + [F.max(n).alias(n) for n in greatest]
    return read_positions(counts, keys, _VALUE, _ROWS, positions, merged)


def top(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """The first rows in the given order; None keeps them all."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)
