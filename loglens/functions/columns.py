"""Columns that are computed once, whatever reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def generated(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that later steps read and never compute again.

    They are generated, so a filter on them stays above and is not rewritten in terms of
    the columns they come from.
    """
    line = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(line)))
