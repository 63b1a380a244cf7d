"""Running sums per key over time, split so that no key is one task.

The time line of a key is cut into slices of a second, and these are put together in blocks. Each slice first adds up on its
own (combined before the shuffle). A block's slices then carry on from each other, and a key's blocks, one small line each,
carry on from each other likewise: two levels of carry, so that neither the rows nor the slices of a key
meet in one task. Inside a slice a sorted window streams the rows. A key holding a third of all rows is
thus spread over as many tasks as it has busy seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_MICROS = 1_000_000
BLOCK_SLICES = 1024

_SLICE = "__slice"
_BLOCK = "__block"
_CARRY = "__carry"


def _carried(sliced: DataFrame, keys: list[str], step: str) -> DataFrame:
    """For each slice that does not start at zero the sum of the key's earlier slices, as a line of its own."""
    sums = sliced.groupBy(*keys, _BLOCK, _SLICE).agg(F.sum(step).alias(step))
    before = Window.unboundedPreceding, -1
    blocks = sums.groupBy(*keys, _BLOCK).agg(F.sum(step).alias(step))
    earlier_blocks = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(*before)
    starts = blocks.withColumn(step, F.coalesce(F.sum(step).over(earlier_blocks), F.lit(0)))
    # A block's start stands in front of its slices.
    both = sums.unionByName(starts.withColumn(_SLICE, F.lit(None).cast("long")))
    earlier = Window.partitionBy(*keys, _BLOCK).orderBy(F.asc_nulls_first(_SLICE)).rowsBetween(*before)
    carried = both.withColumn(step, F.sum(step).over(earlier))
    return carried.filter(F.col(_SLICE).isNotNull() & (F.col(step) != 0))


def running_sum(
    steps: DataFrame, keys: list[str], at: str, tie_break: list[str], step: str, result: str
) -> DataFrame:
    """``steps`` with the sum of ``step`` over the key's rows up to and including each row.

    Rows are ordered by ``at`` (integer microseconds) and then by ``tie_break``. ``steps`` is read twice.
    """
    sliced = steps.withColumn(_SLICE, F.floor(F.col(at) / SLICE_MICROS))
    sliced = sliced.withColumn(_BLOCK, F.floor(F.col(_SLICE) / BLOCK_SLICES))
    carried = _carried(sliced, keys, step).withColumn(_CARRY, F.lit(True))
    both = sliced.withColumn(_CARRY, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    # The carried line comes first in its slice.
    within = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(F.desc(_CARRY), at, *tie_break)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return both.withColumn(result, F.sum(step).over(within)).filter(~F.col(_CARRY)).drop(_CARRY, _SLICE, _BLOCK)


def trailing_count(rows: DataFrame, key: str, at: str, order_id: str, span: int, result: str) -> DataFrame:
    """``rows`` with the number of the key's rows in the last ``span`` microseconds.

    The row itself and one exactly ``span`` ago count; of rows at the same instant those
    with a lower ``order_id`` came earlier. Every row steps up by one when it arrives and
    down by one when it has left the span, so the count is a running sum of steps.
    """
    moves = F.array(
        F.struct(F.col(at).alias("at"), F.lit(1).alias("kind")),
        F.struct((F.col(at) + F.lit(span + 1)).alias("at"), F.lit(0).alias("kind")),
    )
    # What leaves carries nothing but its key and order.
    moved = rows.withColumn("__move", F.explode(moves))
    arrives = F.col("__move.kind") == 1
    steps = moved.select(
        key, order_id, F.col("__move.at").alias(at), F.col("__move.kind").alias("__kind"),
        F.when(arrives, 1).otherwise(-1).alias("__step"),
        *(F.when(arrives, F.col(c)).alias(c) for c in rows.columns if c not in (key, at, order_id)),
    )
    counted = running_sum(steps, [key], at, ["__kind", order_id], "__step", result)
    return counted.filter(F.col("__kind") == 1).select(*rows.columns, result)


def running_distinct(
    rows: DataFrame, keys: list[str], item: str, at: str, order_id: str, result: str
) -> DataFrame:
    """``rows`` with the number of different items the key has shown up to each row.

    Only an item's first appearance, found by a combinable minimum, steps the count up.
    """
    first = (
        rows.groupBy(*keys, item)
        .agg(F.min(F.struct(at, order_id)).alias("__first"))
        .select(*keys, F.col(f"__first.{at}").alias(at), F.col(f"__first.{order_id}").alias(order_id))
        .withColumns({"__step": F.lit(1), "__kind": F.lit(0)})
    )
    shown = rows.withColumns({"__step": F.lit(0), "__kind": F.lit(1)})
    steps = shown.unionByName(first, allowMissingColumns=True)
    counted = running_sum(steps, keys, at, [order_id, "__kind"], "__step", result)
    return counted.filter(F.col("__kind") == 1).drop("__kind", "__step")
