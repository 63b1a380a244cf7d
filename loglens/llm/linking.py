"""From band keys to components of verified similar nodes, without listing all pairs of a group.

1. Nodes that share a band key form a bucket. In each bucket every member is compared with the
   bucket's centre, the member that shares most buckets over all bands, so that a large group of
   near copies is compared with a few centres only. Verified pairs give first components.
2. Where a bucket without its centre still holds several components, every member outside their largest meets
   the members of other components. Members of one component need no further comparison, since their
   link would change nothing. Of these meetings only those become pairs that can be similar: one
   minus the (weighted) Jaccard similarity is a metric, so the distances of two members from their bucket's centre, which are
   known exactly, differ by no more than their own distance; and their signatures agree as often as those of similar
   nodes do, with four standard deviations allowed for chance. A pair is made in the least bucket that its nodes
   share, once.

Together these find the components that comparing all pairs within buckets would find.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import free_shuffles, frozen
from loglens.llm.components import connected

Verify = Callable[[DataFrame], DataFrame]
#: Signatures are compared by sketches of four bits of each slot, sixteen slots to a 64-bit number.
SLOT_BITS = 4


def sketches(slots: np.ndarray) -> np.ndarray:
    """(nodes, words): four bits of each slot of (nodes, slots) 64-bit hashes, the number of slots filled up to sixteen."""
    n, m = slots.shape
    words = -(-m // 16)
    low = np.zeros((n, words * 16), np.uint64)
    low[:, :m] = slots & np.uint64(15)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(SLOT_BITS)
    return np.bitwise_or.reduce(low.reshape(n, words, 16) << shifts, 2).view(np.int64)


def planes(words: np.ndarray) -> np.ndarray:
    """``sketches`` with every four words of a node turned into four planes, each of one bit of 64 slots.

    Slots that differ in any plane are counted at once, by an expression short enough to be compiled; words left over stay.
    """
    out = words.copy()
    whole = words.shape[1] // SLOT_BITS * SLOT_BITS
    bits = np.unpackbits(words[:, :whole].astype("<i8").view(np.uint8).reshape(len(words), -1, 8 * SLOT_BITS), axis=2, bitorder="little")
    bits = bits.reshape(len(words), -1, 64, SLOT_BITS).swapaxes(2, 3)
    out[:, :whole] = np.packbits(np.ascontiguousarray(bits), axis=3, bitorder="little").reshape(len(words), -1).view("<i8")
    return out


def most_different(slots: int, similarity: float) -> int:
    """How many of ``slots`` may differ in the sketches of nodes of at least that similarity."""
    p = (1 - similarity) * (1 - 2.0**-SLOT_BITS)
    return int(slots * p + 4 * (slots * p * (1 - p)) ** 0.5)


def _differing(a: str, b: str, words: int) -> Column:
    """How many slots differ in two sketches as ``planes`` makes them."""

    def left_over(i: int) -> str:
        x = f"({a}[{i}] ^ {b}[{i}])"
        pairs = f"({x} | shiftrightunsigned({x}, 1))"
        return f"bit_count(({pairs} | shiftrightunsigned({pairs}, 2)) & {0x1111111111111111}L)"

    def of_planes(i: int) -> str:
        return "bit_count(" + " | ".join(f"({a}[{i + k}] ^ {b}[{i + k}])" for k in range(SLOT_BITS)) + ")"

    whole = words // SLOT_BITS * SLOT_BITS
    return F.expr(" + ".join([*map(of_planes, range(0, whole, SLOT_BITS)), *map(left_over, range(whole, words))]))


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, weight, members) for buckets of at least two members, from (node, weight, bands)."""
    flat = nodes.select("node", "weight", F.explode("bands").alias("bucket"))
    sizes = flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    found = frozen(flat.join(sizes.hint("shuffle_hash"), "bucket"), "buckets")
    free_shuffles(nodes.sparkSession)
    return found


def similar_components(
    buckets: DataFrame, sketched: Callable[[DataFrame], DataFrame], verify: Verify, least: float, slots: int, similarity: float
) -> DataFrame:
    """(node, component) of nodes with a verified partner.

    ``sketched`` takes some nodes and returns (node, bands, sketch), ``planes`` of the sketches of signatures of so many ``slots``. ``verify`` takes distinct pairs (a, b)
    and returns them with their exact ``similarity``. ``least`` is the least ratio of the weights of two nodes that can be similar at all.
    """
    words = -(-slots // 16)
    fits = F.least("weight", "other_weight") >= F.greatest("weight", "other_weight") * least
    busy = buckets.groupBy("node").agg(F.sum("members").alias("busy"))
    centres = (
        buckets.join(busy, "node").groupBy("bucket")
        .agg(F.max(F.struct("busy", F.col("node").alias("centre"), F.col("weight").alias("other_weight"))).alias("c"))
        .select("bucket", "c.centre", "c.other_weight")
    )
    around = frozen(buckets.drop("members").join(centres, "bucket").filter("node != centre"), "around")
    stars = frozen(
        around.filter(fits).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "stars"
    )
    measured = frozen(verify(stars), "verified")
    close = F.col("similarity") >= similarity
    first = frozen(connected(measured.filter(close)), "components")

    # Centres have met every member of their bucket; only the others may still have to meet.
    member = around.drop("other_weight").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = member.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    member = frozen(member.join(mixed.select("bucket"), "bucket", "left_semi"), "open")
    known = sketched(frozen(member.select("node").distinct(), "unsettled"))
    member = frozen(
        member.withColumns({"a": F.least("node", "centre"), "b": F.greatest("node", "centre")})
        .join(measured, ["a", "b"], "left")
        .select("bucket", "node", "weight", "component", (1 - F.col("similarity")).alias("far")).join(known, "node"),
        "mixed",
    )
    main = (
        member.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("bucket").agg(F.max(F.struct("n", F.col("component").alias("main"))).alias("m"))
        .select("bucket", "m.main")
    )
    outside = member.join(main, "bucket").filter("component != main")
    others = member.select(
        "bucket", F.col("node").alias("other"), F.col("weight").alias("other_weight"),
        F.col("component").alias("other_component"), F.col("sketch").alias("other_sketch"),
        F.col("bands").alias("other_bands"), F.col("far").alias("other_far"),
    )
    reach = F.coalesce(F.abs(F.col("far") - F.col("other_far")) <= 1 - similarity + 1e-9, F.lit(True))
    once = F.col("bucket") == F.array_min(F.array_intersect("bands", "other_bands"))
    alike = _differing("sketch", "other_sketch", words) <= most_different(slots, similarity)
    rest = (
        outside.join(others, "bucket").filter(fits)
        .filter("component != other_component and (other_component = main or node < other)").filter(reach).filter(alike).filter(once)
        .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
        .join(stars, ["a", "b"], "left_anti")
    )
    more = frozen(verify(frozen(rest, "rest")).filter(close), "verified")
    return connected(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b")))
