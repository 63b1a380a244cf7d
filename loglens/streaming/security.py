"""Security events from a stream of requests.

Rules about one request run as plain expressions. The rules about an address's past keep
per address: how often it arrived and tried to log in at each instant of the trailing window, the
paths not found in the current session (in the state store, not in memory) and a timer that forgets
the address when neither window nor session can still matter. What an address adds in one
micro-batch is bounded by the source's rate limit. A late row counts all rows before it; events
already given out are not taken back.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loglens.functions import threats
from loglens.functions.times import micros
from loglens.operators import security
from loglens.operators.security import DEFAULTS, RuleSettings

# Workers get this module's functions with the task and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WATERMARK = "5 minutes"
_SECOND = 1_000_000

_COUNTED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("at_us", T.LongType()),
        T.StructField("remote_ip", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("no_agent", T.BooleanType()),
        T.StructField("in_window", T.LongType()),
        T.StructField("attempts", T.LongType()),
        T.StructField("paths", T.LongType()),
    ]
)
_TIMES = T.StructType(
    [T.StructField("at", T.ArrayType(T.LongType())), T.StructField("rows", T.ArrayType(T.LongType()))]
)
_SEEN = T.StructType([T.StructField("at", T.LongType()), T.StructField("paths", T.LongType())])
_PATH = T.StructType([T.StructField("path", T.StringType())])
_MARK = T.StructType([T.StructField("known", T.BooleanType())])


def trailing_counts(
    earlier: tuple[list[int], list[int]], arrivals: np.ndarray, span: int, settled: int
) -> tuple[np.ndarray, tuple[list[int], list[int]]]:
    """For sorted arrivals, how many came within ``span`` up to each, and what to keep.

    ``earlier`` and what is kept are instants and their numbers of rows. No row from before
    ``settled`` will come any more.
    """
    before, rows = (np.asarray(part, dtype="int64") for part in earlier)
    passed = np.concatenate([[0], np.cumsum(rows)])

    def within(side: str, instants: np.ndarray) -> np.ndarray:
        return passed[np.searchsorted(before, instants, side=side)]

    # Up to each arrival there are the earlier ones not after it and the new ones in order.
    so_far = within("right", arrivals) + np.arange(1, len(arrivals) + 1)
    gone = within("left", arrivals - span) + np.searchsorted(arrivals, arrivals - span, side="left")
    instants, place = np.unique(np.concatenate([before, arrivals]), return_inverse=True)
    merged = np.zeros(len(instants), dtype="int64")
    np.add.at(merged, place, np.concatenate([rows, np.ones(len(arrivals), dtype="int64")]))
    needed = instants >= min(instants[-1], settled) - span
    return so_far - gone, (instants[needed].tolist(), merged[needed].tolist())


class AddressRules(StatefulProcessor):
    """Counts of the trailing windows and of the session of one address."""

    def __init__(self, settings: dict) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrivals = handle.getValueState("arrivals", _TIMES)
        self.logins = handle.getValueState("logins", _TIMES)
        self.seen = handle.getValueState("seen", _SEEN)
        self.missing = handle.getMapState("missing", _PATH, _MARK)

    def _times(self, state) -> tuple[list[int], list[int]]:
        return tuple(map(list, state.get())) if state.exists() else ([], [])

    def _count_paths(self, rows: pd.DataFrame) -> np.ndarray:
        """Up to each row, how many different paths the session has missed; the state is asked once for each different path."""
        last, known = self.seen.get() if self.seen.exists() else (None, 0)
        at = rows["at_us"].to_numpy(dtype="int64")
        newest = np.maximum.accumulate(np.append(at[0] if last is None else last, at))
        session = np.cumsum(at - newest[:-1] > self.settings["session_gap_seconds"] * _SECOND)
        missed = pd.DataFrame({"session": session, "path": rows["missing_path"]}).dropna()
        first = missed.drop_duplicates()
        old = [s == 0 and self.missing.containsKey((p,)) for s, p in zip(first["session"], first["path"])]
        first = first[~np.array(old, dtype=bool)]
        steps = np.zeros(len(at), dtype="int64")
        steps[first.index] = 1
        so_far = np.cumsum(steps)
        # Of each session but the first, what came before it does not count.
        starts = np.searchsorted(session, session)
        counts = so_far - np.where(session > 0, so_far[starts] - steps[starts], -known)
        if session[-1] > 0:
            self.missing.clear()
        for path in first.loc[first["session"] == session[-1], "path"]:
            self.missing.updateValue((path,), (True,))
        self.seen.update((int(newest[-1]), int(counts[-1])))
        return np.where(rows["missing_path"].notna(), counts, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self.settings
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at_us", "id"], ignore_index=True)
        at = batch["at_us"].to_numpy(dtype="int64")
        settled = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        in_window, kept = trailing_counts(self._times(self.arrivals), at, s["rate_seconds"] * _SECOND, settled)
        self.arrivals.update(kept)

        paths = self._count_paths(batch)
        is_login = batch["is_login"].to_numpy(dtype=bool)
        attempts = np.zeros(len(batch), dtype="int64")
        if is_login.any():
            attempts[is_login], kept = trailing_counts(
                self._times(self.logins), at[is_login], s["login_seconds"] * _SECOND, settled
            )
            self.logins.update(kept)

        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # Timers count milliseconds; what is known outlives the longest span itself. A late batch
        # does not move the timer back.
        newest = self.seen.get()[0]
        longest = max(s["session_gap_seconds"], s["login_seconds"], s["rate_seconds"])
        self.handle.registerTimer(newest // 1000 + longest * 1000 + 1)

        batch = batch.assign(in_window=in_window, attempts=attempts, paths=paths)
        raised = (
            (batch["in_window"] >= s["rate_threshold"])
            | (batch["no_agent"] & (batch["in_window"] > s["empty_agent_over"]))
            | ((batch["method"] == "OPTIONS") & (batch["in_window"] > s["options_over"]))
            | (batch["attempts"] > s["logins_over"])
            | (batch["paths"] > s["scan_paths_over"])
        )
        yield batch.loc[raised, _COUNTED.fieldNames()].astype({"in_window": "int64", "attempts": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.arrivals, self.logins, self.seen, self.missing):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def count_by_address(requests: DataFrame, s: RuleSettings = DEFAULTS, *, watermark: str = WATERMARK) -> DataFrame:
    """Requests at which a rule about the address's past may fire, with their counts."""
    missing = F.when(F.col("status") == 404, F.lower(F.coalesce("path", F.lit(""))))
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    rows = timed.select(
        "id", "ts", micros(F.col("ts")).alias("at_us"), "remote_ip", "host", "uri",
        threats.upper_method().alias("method"),
        threats.has_no_agent().alias("no_agent"),
        threats.is_login_attempt().alias("is_login"),
        missing.alias("missing_path"),
    )
    return rows.groupBy("remote_ip").transformWithStateInPandas(
        AddressRules(vars(s).copy()), outputStructType=_COUNTED, outputMode="Append", timeMode="EventTime"
    ).withColumn("ts", F.timestamp_micros("at_us"))


def stream_past(requests: DataFrame, s: RuleSettings = DEFAULTS, *, watermark: str = WATERMARK) -> DataFrame:
    """The events of the rules about an address's past. Its state needs the RocksDB state store."""
    return security.counted_events(count_by_address(requests, s, watermark=watermark), s)


def stream_security(requests: DataFrame, s: RuleSettings = DEFAULTS, *, watermark: str = WATERMARK) -> DataFrame:
    """All security events of a stream. Its state needs the RocksDB state store."""
    own = security.single_request_events(requests.withColumn("ts", F.col("ts").cast("timestamp")), s)
    return own.unionByName(stream_past(requests, s, watermark=watermark))
