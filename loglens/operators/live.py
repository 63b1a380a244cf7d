"""Live traffic metrics over a trailing window of seconds.

Requests are added up per slot, the longest stretch that divides step and window. From then on a slot is two changes: it
enters the windows at its end and leaves them a window later. Sums are running differences of what enters
and leaves; a visitor enters and leaves once for all slots without a gap between them; the median follows the counted
values through time in stretches of a few windows, each line in at most two. What the windows hold is told by one line for
each change, however many windows a slot falls in; only the result itself has a row for every window.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.filters import RequestFilter, stream_filter, within
from loglens.functions import measures as m
from loglens.functions.text import none_if_empty
from loglens.functions.times import micros
from loglens.operators.summaries import lines, summarize, upper_median
from loglens.session import stored
from loglens.timerange import TimeRange, naive_utc

WINDOW_SECONDS = 30
_CLASSES = ("2xx", "3xx", "4xx", "5xx")
_SECOND = 1_000_000


def _totals() -> dict[str, Column]:
    by_class = {f"req_{c}": m.count_if(F.col("status_class") == c) for c in _CLASSES}
    return {
        "req_count": m.requests(),
        **by_class,
        "bytes_out": m.bytes_out(),
        "bytes_in": m.bytes_in(),
    }


def _edges() -> dict[str, Column]:
    """Last and first instant; the first one as the greatest negative number."""
    return {"last_us": F.col("at_us"), "minus_first_us": -F.col("at_us")}


def _measured(requests: DataFrame) -> DataFrame:
    return requests.withColumns(
        {"at_us": micros(F.col("ts")), "visitor": none_if_empty(F.col("remote_ip")), "__value": F.col("duration_ms")}
    )


def rates(summary: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Counts per window to rates; the time between first and last request, at least half a
    second, divides, or the whole window when there is a single request."""
    n = F.col("req_count")
    between = F.greatest((F.col("last_us") + F.col("minus_first_us")) / _SECOND, F.lit(0.5))
    elapsed = F.when(n >= 2, between).otherwise(F.lit(float(seconds)))

    def rate(count: str) -> Column:
        return F.bround(F.col(count) / elapsed, 2)

    return summary.select(
        *keys,
        "req_count",
        rate("req_count").alias("rps"),
        *[rate(f"req_{c}").alias(f"rps_{c}") for c in _CLASSES],
        m.ratio(F.col("req_4xx") + F.col("req_5xx"), n, 4).alias("error_rate"),
        "unique_ips",
        F.coalesce(F.col("p50").cast("int"), F.lit(0)).alias("p50_ms"),
        "bytes_out",
        "bytes_in",
        *[f"req_{c}" for c in _CLASSES],
    )


def live_metrics_at(requests: DataFrame, now: datetime, *, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Metrics of the ``seconds`` before ``now``, both ends included."""
    end = naive_utc(now)
    rows = within(requests, TimeRange(end - timedelta(seconds=seconds), end))
    summary = summarize(
        _measured(rows), [], _totals(),
        greatest=_edges(),
        distinct=("unique_ips", "visitor"), values="duration_ms", positions={"p50": upper_median},
    )
    return rates(summary.fillna(0), [], seconds)


_BLOCK = 4096  # change points that are put in order together
_STRETCH = 8  # windows whose medians are followed together


def _changes(per_slot: DataFrame, totals: list[str], width: int) -> DataFrame:
    """What changes at each end of a window: counts entering less counts leaving, and the instants of entering and leaving slots."""
    by_value = F.col("__by_value") == 1
    slots = per_slot.filter(by_value).groupBy("slot").agg(
        *[F.sum(t).alias(t) for t in totals], F.max("last_us").alias("last_us"), F.max("minus_first_us").alias("minus_first_us")
    )
    no_instant = F.lit(None).cast("bigint")
    nothing = F.lit(0).cast("bigint")

    def change(at: Column, sign: int, last: Column, first: Column) -> Column:
        return F.struct(
            at.alias("at"), *[(sign * F.col(t)).cast("bigint").alias(t) for t in totals], nothing.alias("unique_ips"),
            last.alias("last_us"), first.alias("minus_first_us"),
        )

    of_slots = slots.select(
        F.inline(
            F.array(
                change(F.col("slot") + 1, 1, F.col("last_us"), no_instant),
                change(F.col("slot") + width + 1, -1, no_instant, F.col("minus_first_us")),
            )
        )
    )
    visits = Window.partitionBy("visitor").orderBy("slot")
    before, after = F.lag("slot").over(visits), F.lead("slot").over(visits)
    visitors = (
        per_slot.filter(~by_value & F.col("__item").isNotNull()).select("slot", F.col("__item").alias("visitor"))
        .withColumns({"before": before, "after": after})
    )
    comes = F.col("before").isNull() | (F.col("slot") > F.col("before") + width)
    goes = F.col("after").isNull() | (F.col("after") > F.col("slot") + width)
    moves = F.array(
        F.when(comes, F.struct((F.col("slot") + 1).alias("at"), F.lit(1).alias("by"))),
        F.when(goes, F.struct((F.col("slot") + width + 1).alias("at"), F.lit(-1).alias("by"))),
    )
    of_visitors = visitors.select(F.explode(F.filter(moves, lambda m: m.isNotNull())).alias("m")).select(
        F.col("m.at").alias("at"), *[nothing.alias(t) for t in totals], F.col("m.by").cast("bigint").alias("unique_ips"),
        no_instant.alias("last_us"), no_instant.alias("minus_first_us"),
    )
    counts = [*totals, "unique_ips"]
    return of_slots.unionByName(of_visitors).groupBy("at").agg(
        *[F.sum(c).alias(c) for c in counts], F.max("last_us").alias("last_us"), F.max("minus_first_us").alias("minus_first_us")
    )


def _held(changes: DataFrame, counts: list[str]) -> DataFrame:
    """What the windows ending from ``at`` up to the next change (``until``) hold.

    Changes are put in order within blocks; of each block one line with what came before it and one with what comes next
    join the blocks, so that no task has the whole time line.
    """
    cut = changes.withColumn("block", F.floor(F.col("at") / _BLOCK)).withColumn("place", F.lit(1))
    in_order = Window.orderBy("block")
    earlier, later = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(1, Window.unboundedFollowing)
    blocks = cut.groupBy("block").agg(
        *[F.sum(c).alias(c) for c in counts], F.max_by("last_us", F.when(F.col("last_us").isNotNull(), F.col("at"))).alias("last_us"),
        F.min_by("minus_first_us", F.when(F.col("minus_first_us").isNotNull(), F.col("at"))).alias("minus_first_us"),
        F.min("at").alias("at"),
    )
    none = F.lit(None).cast("bigint")
    before = blocks.select(
        none.alias("at"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.last("last_us", ignorenulls=True).over(earlier).alias("last_us"), none.alias("minus_first_us"), "block",
        F.lit(0).alias("place"),
    )
    behind = blocks.select(
        F.min("at").over(later).alias("at"), *[F.lit(0).cast("bigint").alias(c) for c in counts], none.alias("last_us"),
        F.first("minus_first_us", ignorenulls=True).over(later).alias("minus_first_us"), "block", F.lit(2).alias("place"),
    )
    within = Window.partitionBy("block").orderBy("place", "at")
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to_come = within.rowsBetween(1, Window.unboundedFollowing)
    held = cut.unionByName(before).unionByName(behind).select(
        "at", "place", *[F.sum(c).over(so_far).alias(c) for c in counts],
        F.last("last_us", ignorenulls=True).over(so_far).alias("last_us"),
        # The next slot to leave is the oldest one held.
        F.first("minus_first_us", ignorenulls=True).over(to_come).alias("minus_first_us"),
        F.lead("at").over(within).alias("until"),
    )
    return held.filter((F.col("place") == 1) & (F.col("req_count") > 0)).drop("place")


def _medians(per_slot: DataFrame, width: int) -> DataFrame:
    """The upper median of the durations that the windows ending at each change hold."""
    stretch = width * _STRETCH
    rows = per_slot.filter(F.col("__by_value") == 1).groupBy("slot", F.col("__value").cast("double").alias("value")).agg(
        F.sum("__rows").alias("n")
    )
    touched = F.sequence(F.floor((F.col("slot") + 1) / stretch), F.floor((F.col("slot") + width) / stretch))

    def followed(key: tuple, lines: pd.DataFrame) -> pd.DataFrame:
        start = key[0] * stretch
        slot, value, n = (lines[c].to_numpy() for c in ("slot", "value", "n"))
        leaves = slot + width + 1
        points = np.unique(np.concatenate([[start], slot + 1, leaves]))
        points = points[(points >= start) & (points < start + stretch)]
        given = ~np.isnan(value)
        values, place = np.unique(value[given], return_inverse=True)
        at = np.concatenate([np.maximum(slot[given] + 1, start), leaves[given]])
        by, place = np.concatenate([n[given], -n[given]]), np.concatenate([place, place])
        order = np.argsort(at, kind="stable")
        at, by, place = at[order], by[order], place[order]
        edges = np.searchsorted(at, points, side="right")
        counts, medians, done = np.zeros(len(values), np.int64), [], 0
        for edge in edges:
            np.add.at(counts, place[done:edge], by[done:edge])
            done = edge
            upto = np.cumsum(counts)
            some = len(upto) and upto[-1] > 0
            medians.append(values[np.searchsorted(upto, upto[-1] // 2, side="right")] if some else None)
        return pd.DataFrame({"at": points, "p50": pd.array(medians, "Float64")})

    spread = rows.withColumn("stretch", F.explode(touched))
    return spread.groupBy("stretch").applyInPandas(followed, "at bigint, p50 double")


def live_metrics(
    requests: DataFrame, f: RequestFilter | None = None, *, seconds: int = WINDOW_SECONDS, step: int = 1,
    folder: str | None = None,
) -> DataFrame:
    """Metrics of every window [end - seconds, end) with traffic, one each ``step`` seconds.

    What was added up per slot is stored in the shared folder when this is called, or in ``folder``, where the next
    call replaces it.
    """
    slot_seconds = gcd(seconds, step)
    rows = _measured(stream_filter(requests, f) if f else requests)
    rows = rows.withColumn("slot", F.floor(F.col("at_us") / (slot_seconds * _SECOND)))
    totals = _totals()
    parts = m.named(totals) + [F.max(c).alias(n) for n, c in _edges().items()]
    per_slot = stored(lines(rows, ["slot"], parts, "visitor"), "live-slots", folder)
    width, every = seconds // slot_seconds, step // slot_seconds
    held = _held(_changes(per_slot, list(totals), width), [*totals, "unique_ips"])
    told = held.join(_medians(per_slot, width), "at", "left")
    # Windows end at multiples of the step; the last change behind all requests leaves nothing held.
    first = F.ceil(F.col("at") / every) * every
    last = F.floor((F.col("until") - 1) / every) * every
    ends = F.when(first <= last, F.sequence(first, last, F.lit(every).cast("bigint")))
    each = told.withColumn("slot", F.explode(ends))
    end = F.timestamp_micros(F.col("slot") * (slot_seconds * _SECOND)).cast(requests.schema["ts"].dataType)
    return rates(each.withColumn("window_end", end), ["window_end"], seconds)


def live_metrics_filtered(requests: DataFrame, f: RequestFilter, *, seconds: int = WINDOW_SECONDS, step: int = 1) -> DataFrame:
    """The same for the requests a viewer selected."""
    return live_metrics(requests, f, seconds=seconds, step=step)
