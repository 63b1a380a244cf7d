"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is bisected
between 0 (all sources alike) and 1 (as they come) until the mixture reaches a target entropy, and raised until no
source is repeated more often than allowed. Weights become token quotas of a budget. A quota is realised
as whole passes over the source, each a permutation of its own, and one pass that stops where
the quota is used up.

No source is sorted: tokens are summed by ranges of the permutation key, only the range in which a quota
ends is looked at row by row, and the place found is a single number by which all rows are then chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import free_name, frozen, text_or_empty

KEY_BITS, RANGE_BITS = 60, 14
ROUNDS = 40
WHITE = " \t\n\x0b\x0c\r"


def white_space_tokens(text_column: str = "text") -> Column:
    """Pieces between white-space characters; a cheap, exact measure of length. An empty text has none."""
    text = text_or_empty(text_column)
    pieces = F.length(text) - F.length(F.translate(text, WHITE, "")) + 1
    return F.when(F.length(text) == 0, 0).otherwise(pieces).cast("long")


def permutation_key(block: Column, id_column: str = "doc_id", text_column: str = "text") -> Column:
    """Where a row stands in a block's permutation, from 0 to 2**60."""
    identity = F.concat_ws(":", block.cast("string"), F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.md5(text_or_empty(text_column).cast("binary")))
    return F.conv(F.substring(F.md5(identity.cast("binary")), 1, 15), 16, 10).cast("long")


def _bisect(sources: DataFrame, holds) -> float:
    """The least exponent from 0 to 1 (in steps of 2**-40) at which ``holds`` is true; 1 if it never is.

    One small aggregation over the sources for each step; sources are never collected.
    """
    lo, hi = 0.0, 1.0
    if holds(0.0):
        return 0.0
    for _ in range(ROUNDS):
        mid = (lo + hi) / 2
        if holds(mid):
            hi = mid
        else:
            lo = mid
    return hi


def temperature(sources: DataFrame, target_entropy: float, max_repeats: float, budget: float) -> float:
    """The exponent for (source, tokens): the largest whose mixture has at least ``target_entropy`` nats, unless
    the repetition limit asks for a larger one.

    Entropy falls and repetition falls as the exponent grows. A target above the logarithm of the number of
    sources gives 0, a target below the entropy of the shares gives 1.
    """
    total = sources.agg(F.sum("tokens").alias("t")).first()["t"]
    if not total:
        return 1.0
    share = sources.filter("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def mixture(exponent: float):
        up = F.pow("p", F.lit(exponent))
        z, plogp, most = share.agg(
            F.sum(up), F.sum(up * F.log(up)), F.max(F.pow("p", F.lit(exponent - 1.0)))
        ).first()
        return _ln(z) - plogp / z, most / z * (budget / total)

    entropic = _bisect(sources, lambda x: mixture(x)[0] < target_entropy)
    repeated = _bisect(sources, lambda x: mixture(x)[1] <= max_repeats)
    return max(entropic, repeated)


def _ln(x: float) -> float:
    from math import log

    return log(x)


def plan(
    docs: DataFrame, target_share: float = 0.95, max_repeats: float = 4.0, epochs: float = 1.0,
    id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
) -> DataFrame:
    """One row per source: tokens, exponent, weight, quota, whole passes, and the last key of the pass that stops.

    ``target_share`` is the target entropy as a share of its maximum, the logarithm of the number of sources; the
    budget is ``epochs`` times all tokens, and ``epochs`` above ``max_repeats`` is an error. A null source is a source of its own; sources without tokens get nothing. Stored.
    """
    if epochs > max_repeats:
        raise ValueError("a budget of more epochs than repetitions cannot be met: every source would have to exceed the limit")
    rows = docs.select(
        F.col(source_column).alias("source"), F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text")
    ).withColumn("tokens", white_space_tokens())
    sources = frozen(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), "sources")
    n, total = sources.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    budget = float(total or 0) * epochs
    exponent = temperature(sources, target_share * _ln(max(1, n)), max_repeats, budget)
    power = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(exponent))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    quotas = frozen(
        sources.withColumn("exponent", F.lit(exponent)).withColumn("weight", power / F.lit(z))
        .withColumn("quota", F.floor(F.col("weight") * F.lit(budget)).cast("long"))
        .withColumn("passes", F.expr("quota div tokens"))
        .withColumn("rest", F.expr("quota % tokens")),
        "quotas",
    )
    placed = (
        rows.join(quotas.select(F.col("source").alias("s"), "passes", "rest"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("key", permutation_key(F.col("passes")))
        .select("source", "key", "tokens", "rest", F.shiftright("key", KEY_BITS - RANGE_BITS).alias("range"))
    )
    ranges = placed.groupBy("source", "range", "rest").agg(F.sum("tokens").alias("tokens"))
    by_source = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        ranges.withColumn("before", F.sum("tokens").over(by_source) - F.col("tokens"))
        .filter("before < rest").groupBy("source")
        .agg(F.max(F.struct("range", "before")).alias("e")).select(F.col("source").alias("s"), "e.range", "e.before")
    )
    ends = frozen(ends, "ends")
    in_range = Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, -1)
    last = (
        placed.join(ends, F.col("source").eqNullSafe(F.col("s")) & (placed["range"] == ends["range"]))
        .select("source", "key", "tokens", "rest", "before")
        .withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(in_range), F.lit(0)))
        .filter("start < rest").groupBy("source").agg(F.max("key").alias("last_key")).withColumnRenamed("source", "s")
    )
    return frozen(
        quotas.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest"), "plan"
    )


def mix(
    docs: DataFrame, plan: DataFrame, block: str | None = "block", order: str | None = "position",
    id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
) -> DataFrame:
    """``docs`` with all columns, a row once for each block of its source that holds it.

    ``position``, from 0 to 1, orders the mixture: blocks of a source follow each other, and every source is spread
    evenly over the whole. In the pass that stops, rows stay whose predecessors in the permutation don't yet fill the quota;
    rows with the same id and text share a place and stay together. Rows of sources that are not in the plan, and an
    empty table, give nothing. Names given as None are left out; names that ``docs`` has already are an error.
    """
    taken = {c.lower() for c in docs.columns}
    if any(w and w.lower() in taken for w in (block, order)):
        raise ValueError(f"{block} or {order} is a column of the documents; choose other names")
    number, position = block or free_name(docs, "block"), order or free_name(docs, "position")
    names = {c: free_name(docs, f"plan_{c}") for c in ("source", "tokens", "quota", "passes", "last_key")}
    wanted = plan.select(*(F.col(c).alias(n) for c, n in names.items()))
    last = names["last_key"]
    passes = F.col(names["passes"])
    rows = docs.join(wanted, F.col(source_column).eqNullSafe(F.col(names["source"])))
    end = F.when(permutation_key(passes, id_column, text_column) <= F.col(last), passes).otherwise(passes - 1)
    rows = rows.withColumn(number, F.explode(F.when(end >= 0, F.sequence(F.lit(0).cast("long"), end)).otherwise(F.array().cast("array<bigint>"))))
    place = permutation_key(F.col(number), id_column, text_column) / F.lit(float(1 << KEY_BITS))
    rows = rows.withColumn(position, (F.col(number) + place) * F.col(names["tokens"]) / F.greatest(F.col(names["quota"]), F.lit(1)))
    return rows.drop(*names.values(), *([] if block else [number]), *([] if order else [position]))
