"""Threshold alerts: rules over sliding five-minute metrics, with a cooldown per rule."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions import measures as m
from loglens.functions.times import micros
from loglens.operators.summaries import percentile, read_positions
from loglens.schema import ALERT_CONDITIONS_SCHEMA
from loglens.session import stored

# Workers get this module's functions with the task and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALL_HOSTS = "*"
_DEFAULT_COOLDOWN = 30
_MINUTE_MICROS = 60_000_000
# A block of a rule's time line lasts a week, or eight cooldowns where these are longer.
_BLOCK_MICROS = 7 * 24 * 60 * _MINUTE_MICROS
_BLOCK_PAUSES = 8


def _minute(df: DataFrame) -> Column:
    return F.date_trunc("minute", "ts").cast(df.schema["ts"].dataType)


def _scoped(df: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Every line once for its host and once for all hosts; only for the scopes of ``rules``, where these are given."""
    found = df.withColumn("scope", F.explode(F.array(F.lit(ALL_HOSTS), F.col("host"))))
    if rules is None:
        return found
    # Half of the lines have one scope: dealt by scope they would meet in one task.
    return found.join(F.broadcast(read_rules(rules).select("scope")), "scope", "left_semi")


def _per_tick(per_minute: DataFrame, minutes: int, *measures: Column) -> DataFrame:
    """Minutes added to the windows [tick - minutes, tick) that cover them.

    Only the per-minute lines are copied, never the requests.
    """
    one = F.expr("INTERVAL '1' MINUTE")
    ticks = F.sequence(F.col("minute") + one, F.col("minute") + F.expr(f"INTERVAL '{minutes}' MINUTE"), one)
    return per_minute.withColumn("tick", F.explode(ticks)).groupBy("tick", "scope").agg(*measures)


def window_metrics(requests: DataFrame, rules: DataFrame | None = None, *, minutes: int = 5) -> DataFrame:
    """Requests, errors, bytes and the worst minute's 95th percentile per window and scope."""
    per_value = requests.groupBy(_minute(requests).alias("minute"), "host", "duration_ms").agg(
        m.requests().alias("n"), m.errors().alias("errors"), m.bytes_out().alias("bytes_out")
    )
    sums = [F.sum(c).alias(c) for c in ("n", "errors", "bytes_out")]
    counts = _scoped(per_value, rules).groupBy("minute", "scope", "duration_ms").agg(*sums)
    per_minute = read_positions(
        counts, ["minute", "scope"], "duration_ms", "n", {"p95": percentile(0.95)}, sums
    ).withColumn("p95", m.whole_ms(F.col("p95")))
    return _per_tick(per_minute, minutes, *sums, F.max("p95").alias("p95"))


def event_metrics(events: DataFrame, rules: DataFrame | None = None, *, minutes: int = 5) -> DataFrame:
    """Security events per window and scope."""
    per_host = events.groupBy(_minute(events).alias("minute"), "host").agg(m.requests().alias("n"))
    per_minute = _scoped(per_host, rules).groupBy("minute", "scope").agg(F.sum("n").alias("n"))
    return _per_tick(per_minute, minutes, F.sum("n").alias("n"))


def _metric(df: DataFrame, metric: str, value: Column, digits: int) -> DataFrame:
    return df.select(
        "tick", "scope", F.lit(metric).alias("metric"),
        value.cast("double").alias("value"), F.bround(value.cast("double"), digits).alias("shown"),
    )


def alert_request_rate(requests: DataFrame, *, minutes: int = 5) -> DataFrame:
    """Requests per minute at every tick."""
    return _metric(window_metrics(requests, minutes=minutes), "request_rate", F.col("n") / max(minutes, 1), 1)


def alert_error_rate(requests: DataFrame, *, minutes: int = 5) -> DataFrame:
    rate = m.ratio(F.col("errors"), F.col("n"), 4)
    return _metric(window_metrics(requests, minutes=minutes), "error_rate", rate, 4)


def alert_latency_p95(requests: DataFrame, *, minutes: int = 5) -> DataFrame:
    return _metric(window_metrics(requests, minutes=minutes), "latency_p95", F.col("p95"), 0)


def alert_bandwidth(requests: DataFrame, *, minutes: int = 5) -> DataFrame:
    return _metric(window_metrics(requests, minutes=minutes), "bandwidth", F.col("bytes_out"), 0)


def alert_security_event(events: DataFrame, rules: DataFrame | None = None, *, minutes: int = 5) -> DataFrame:
    return _metric(event_metrics(events, rules, minutes=minutes), "security_event", F.col("n"), 0)


def all_metrics(
    requests: DataFrame, events: DataFrame | None = None, *, minutes: int = 5, rules: DataFrame | None = None
) -> DataFrame:
    """All metrics in long form, computed together from one aggregation.

    With ``rules`` only the hosts that these watch are added up, before lines are copied to the windows.
    """
    wide = window_metrics(requests, rules, minutes=minutes)
    entries = {
        "request_rate": (F.col("n") / max(minutes, 1), 1),
        "error_rate": (m.ratio(F.col("errors"), F.col("n"), 4), 4),
        "latency_p95": (F.col("p95"), 0),
        "bandwidth": (F.col("bytes_out"), 0),
    }
    long = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                value.cast("double").alias("value"),
                F.bround(value.cast("double"), digits).alias("shown"),
            )
            for name, (value, digits) in entries.items()
        ]
    )
    found = wide.select("tick", "scope", F.inline(long))
    return found if events is None else found.unionByName(alert_security_event(events, rules, minutes=minutes))


def read_rules(rules: DataFrame) -> DataFrame:
    """Enabled threshold rules with their conditions as columns."""
    condition = F.from_json("conditions", ALERT_CONDITIONS_SCHEMA)
    return rules.filter(F.col("enabled") & (F.col("rule_type") == "threshold")).select(
        F.col("id").alias("rule_id"),
        condition["metric"].alias("metric"),
        F.coalesce(condition["threshold"], F.lit(0.0)).alias("threshold"),
        F.coalesce(condition["host"], F.lit(ALL_HOSTS)).alias("scope"),
        F.coalesce("cooldown_minutes", F.lit(_DEFAULT_COOLDOWN)).alias("cooldown_minutes"),
        "last_triggered",
    )


def _later_fires(at: np.ndarray, pause: int) -> np.ndarray:
    """For each of the sorted breaches the position of the next one to fire, if it fires itself; their number where none does."""
    return np.maximum(np.searchsorted(at, at + pause), np.arange(1, len(at) + 1))


def _block_ends(breaches: pd.DataFrame) -> pd.DataFrame:
    """Of one rule's block the breaches that may be its first to fire, each with the block's last one to fire then.

    A pause from an earlier block ends before the block is one pause old, so that later breaches but one are no first ones.
    """
    at = np.sort(breaches["at"].to_numpy())
    pause, start = int(breaches["pause"].iloc[0]), int(breaches["block_start"].iloc[0])
    later, last = _later_fires(at, pause).tolist(), list(range(len(at)))
    for i in reversed(range(len(at))):
        if later[i] < len(at):
            last[i] = last[later[i]]
    firsts = min(len(at), int(np.searchsorted(at, start + max(pause, 0))) + 1)
    found = breaches[["rule_id", "pause", "block"]].head(1)
    return found.assign(firsts=[at[:firsts].tolist()], lasts=[at[last[:firsts]].tolist()])


def _block_firsts(blocks: pd.DataFrame) -> pd.DataFrame:
    """The first breach to fire in each block of one rule that has one: a line for each block is carried on to the next."""
    blocks = blocks.sort_values("block", ignore_index=True)
    pause, quiet_until = int(blocks["pause"].iloc[0]), None
    found = []
    for position, (firsts, lasts) in enumerate(zip(blocks["firsts"], blocks["lasts"])):
        i = 0 if quiet_until is None or pause <= 0 else int(np.searchsorted(firsts, quiet_until))
        if i < len(firsts):
            found.append((position, int(firsts[i])))
            quiet_until = int(lasts[i]) + pause
    at = [position for position, _ in found]
    return blocks.loc[at, ["rule_id", "block"]].assign(first=np.array([first for _, first in found], "int64"))


def _block_fires(breaches: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
    """The breaches of one rule's block that fire, from the first one on."""
    fired = []
    if len(breaches) and len(start):
        breaches = breaches.sort_values("at", ignore_index=True, kind="stable")
        at = breaches["at"].to_numpy()
        later = _later_fires(at, int(breaches["pause"].iloc[0]))
        i = int(np.searchsorted(at, start["first"].iloc[0]))
        while i < len(at):
            fired.append(i)
            i = int(later[i])
    return breaches.iloc[fired][["rule_id", "tick", "metric", "shown", "threshold"]]


def _after_cooldown(breaches: DataFrame) -> DataFrame:
    """The breaches that fire: each silences its rule for its cooldown.

    A rule's time line is cut into blocks. Each block first says, for every breach that may be its first one to fire, which is then
    its last; one line for each block is carried on to the next, and blocks whose first one is known fire on their own. Blocks are as long
    as a week or eight cooldowns, so neither the breaches nor the groups of a task grow with the time that the log covers.
    ``breaches`` is read several times.
    """
    # An id that stands on several lines has the settings of its earliest breach.
    settings = breaches.groupBy(F.col("rule_id").alias("id")).agg(
        F.min(F.struct("tick", "cooldown_minutes", "last_triggered")).alias("set")
    )
    pause = F.col("set.cooldown_minutes").cast("bigint") * _MINUTE_MICROS
    at, last = micros(F.col("tick")), micros(F.col("set.last_triggered"))
    loud = (
        breaches.join(F.broadcast(settings), F.col("rule_id").eqNullSafe(F.col("id")))
        .withColumns({"at": at, "pause": pause})
        .filter(last.isNull() | (F.col("at") - last >= F.col("pause")))
    )
    span = F.greatest(F.lit(_BLOCK_MICROS), F.col("pause") * _BLOCK_PAUSES)
    lined_up = loud.withColumn("block", F.floor(F.col("at") / span)).withColumn("block_start", F.col("block") * span)
    lined_up = lined_up.select(
        "rule_id", "tick", "metric", "shown", "threshold", "at", "pause", "block", "block_start"
    )
    ends = lined_up.select("rule_id", "at", "pause", "block", "block_start").groupBy("rule_id", "block").applyInPandas(
        _block_ends, "rule_id int, pause long, block long, firsts array<long>, lasts array<long>"
    )
    firsts = ends.groupBy("rule_id").applyInPandas(_block_firsts, "rule_id int, block long, first long")
    kind = breaches.schema["tick"].dataType.simpleString()
    return (
        lined_up.groupBy("rule_id", "block")
        .cogroup(firsts.groupBy("rule_id", "block"))
        .applyInPandas(_block_fires, f"rule_id int, tick {kind}, metric string, shown double, threshold double")
    )


def alert_evaluate(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """The alerts that fire, one row each, with the details a notification shows.

    A rule sees at most one line per tick. The breaches are stored in the shared folder, since they are read several times.
    """
    active = F.broadcast(read_rules(rules))
    breaches = metrics.join(active, ["metric", "scope"]).filter((F.col("value") > F.col("threshold")) & F.col("tick").isNotNull())
    at = metrics.schema["tick"].dataType.simpleString()
    lined_up = breaches.select(
        "rule_id", "tick", "metric", "shown", "threshold", "cooldown_minutes",
        F.col("last_triggered").cast(at).alias("last_triggered"),
    )
    fired = _after_cooldown(stored(lined_up, "breaches"))
    details = F.to_json(F.struct("metric", F.col("shown").alias("value"), "threshold"))
    return fired.select("rule_id", F.col("tick").alias("triggered_at"), details.alias("details"))


def alert_record(fired: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New history rows, and the rules with the time they last fired."""
    history = fired.select(
        F.xxhash64("rule_id", "triggered_at").alias("id"),
        "rule_id", "triggered_at",
        F.lit(None).cast(fired.schema["triggered_at"].dataType).alias("resolved_at"),
        "details",
    )
    latest = fired.groupBy(F.col("rule_id").alias("id")).agg(F.max("triggered_at").alias("__latest"))
    kind = rules.schema["last_triggered"].dataType
    updated = (
        rules.join(latest, "id", "left")
        .withColumn("last_triggered", F.coalesce(F.col("__latest").cast(kind), F.col("last_triggered")))
        .drop("__latest")
    )
    return history, updated


def alert_history(history: DataFrame, rules: DataFrame, *, limit: int = 100, offset: int = 0) -> DataFrame:
    """Fired alerts with the name of their rule, newest first."""
    names = rules.groupBy(F.col("id").alias("rule_id")).agg(F.min("name").alias("rule_name"))
    return (
        history.join(names, "rule_id", "left")
        .orderBy(F.desc("triggered_at"), F.asc("rule_id"))
        .offset(offset)
        .limit(limit)
    )
