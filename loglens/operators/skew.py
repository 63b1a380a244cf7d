"""Attaching per-key columns to a large table in which single keys may be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(facts: DataFrame, key: str, dimension: DataFrame, row_count: str) -> DataFrame:
    """Left-join ``dimension`` (one line per key, with its number of fact rows) to ``facts``.

    The dimension's side of a hot key is a single line, so adaptive execution can split the facts of that key
    over any number of tasks. A dimension column replaces a fact column of the same name.
    """
    attributes = [c for c in dimension.columns if c not in (key, row_count)]
    lines = dimension.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in attributes])
    columns = [c for c in facts.columns if c not in attributes]
    joined = facts.join(lines, F.col(key) == F.col("__key"), "left")
    return joined.select(*columns, *[F.col(f"__{c}").alias(c) for c in attributes])
