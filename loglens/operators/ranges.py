"""Finding the address ranges that hold an address by one sweep over both in order.

Ranges and addresses are put into one order of keys, range partitioned. Going through it, the last range that began before an
address is the only one of its layer that can hold it, if ranges of a layer do not overlap: a table of places is
one layer, networks are one for each prefix length that occurs. The range still open at a partition's edge is carried over
to the next, as one line. Each address is one row, however many ranges there are, and no cell of them is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.session import stored

MOST_LAYERS = 256


def _shared_digits(low: Column, high: Column) -> Column:
    """How many leading digits two keys of equal width share."""
    agree = F.transform(
        F.sequence(F.lit(1), F.length(low)),
        lambda i: F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i),
    )
    return F.size(F.filter(agree, lambda same: same))


def _digit(key: Column, position: Column) -> Column:
    return F.conv(F.substring(key, position, F.lit(1)), 16, 10).cast("int")


def network_layer(low: str, high: str) -> Column:
    """A number that networks share which have the same prefix length: such networks are equal or apart."""
    shared = _shared_digits(F.col(low), F.col(high))
    span = _digit(F.col(high), shared + 1) - _digit(F.col(low), shared + 1)
    return shared * 16 + F.when(F.col(low) == F.col(high), 0).otherwise(span)


def sweep(
    addresses: DataFrame, key: str, ranges: DataFrame, low: str, high: str, layer: str | None = None, found: str = "found"
) -> DataFrame:
    """``addresses`` with an array of the ranges (their other columns) that hold ``key``, at most one of each layer.

    Keys are address keys; ranges whose bounds are of different families, or in the wrong order, are skipped. Ranges of one
    ``layer`` must not overlap; without a layer all are one. Rows without a key find nothing. Both inputs in their common
    order are stored in the shared folder when this is called.
    """
    valid = (F.length(low) == F.length(high)) & (F.substring(low, 1, 1) == F.substring(high, 1, 1))
    payload = [c for c in ranges.columns if c not in (low, high, layer)]
    filed = ranges.filter(valid & (F.col(low) <= F.col(high))).select(
        F.col(low).alias("key"), F.lit(0).alias("kind"), (F.col(layer) if layer else F.lit(0)).cast("int").alias("layer"),
        F.struct(F.col(high).alias("high"), F.struct(*payload).alias("range")).alias("opens"),
    )
    sought = addresses.select(F.col(key).alias("key"), F.lit(1).alias("kind"), F.struct(*addresses.columns).alias("row"))
    both = sought.filter(F.col("key").isNotNull()).unionByName(filed, allowMissingColumns=True)
    in_order = stored(both.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "sweep")

    layers = sorted(r["layer"] for r in in_order.filter("kind = 0").select("layer").distinct().limit(MOST_LAYERS + 1).collect())
    if len(layers) > MOST_LAYERS:
        raise ValueError(f"ranges have more than {MOST_LAYERS} layers")
    opens = {f"open_{n}": F.when(F.col("layer") == n, F.col("opens")) for n in layers}
    rows = in_order.withColumns(opens) if opens else in_order
    parts = rows.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), *[F.max_by(o, F.when(F.col(o).isNotNull(), F.col("key"))).alias(o) for o in opens]
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        "part", F.lit(-1).alias("kind"), *[F.last(o, ignorenulls=True).over(earlier).alias(o) for o in opens]
    )
    within = Window.partitionBy("part").orderBy(F.asc_nulls_first("key"), "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    swept = rows.select("key", "kind", "row", "part", *opens).unionByName(carried, allowMissingColumns=True).withColumns(
        {o: F.last(o, ignorenulls=True).over(within) for o in opens}
    ) if opens else rows
    kind = in_order.schema["opens"].dataType["range"].dataType
    nothing = F.array().cast(f"array<{kind.simpleString()}>")
    held = F.filter(F.array(*[F.when(F.col(f"{o}.high") >= F.col("key"), F.col(f"{o}.range")) for o in opens]), lambda r: r.isNotNull()) if opens else nothing
    hits = swept.filter("kind = 1").select("row.*", held.alias(found))
    return hits.unionByName(addresses.filter(F.col(key).isNull()).withColumn(found, nothing))
