"""Connected components of a graph given as a table of links: union-find as joins.

Each round hangs every node's neighbours on the smallest of them, first the larger neighbours
(large star), then the smaller ones (small star). Paths shrink to stars in a logarithmic number of
rounds. A round moves links, never components: no node's neighbours are gathered in one place, only
their minimum is, and links of a busy node are an ordinary skewed join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import frozen


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = _lowest(both).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    lowest = _lowest(down)
    rest = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return rest.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, component) for each node that has a link; the component is its smallest node.

    Links are unordered; repeated ones, loops and nulls are ignored. No links give an empty table.
    """
    now = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u != v").distinct()
    now = frozen(now, "links")
    before = None
    while True:
        state = now.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))
        ).first()
        if state[0] == 0 or state == before:
            break
        before = state
        now = frozen(_small_star(_large_star(now)), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
