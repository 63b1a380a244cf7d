"""Rollups and live metrics kept up to date from a stream of requests.

Two chained aggregations: the first keeps one line per (window, visitor) and per (window,
duration), spread over all tasks whatever the size of a host; the second adds these lines
up when the watermark closes the window. No state holds a growing list of visitors.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loglens.filters import instant, on_days
from loglens.functions import measures as m
from loglens.functions.text import none_if_empty
from loglens.functions.times import micros
from loglens.operators.live import WINDOW_SECONDS, live_metrics, rates
from loglens.operators.rollups import rollup_minutely

WATERMARK = "5 minutes"
_CLASSES = ("2xx", "3xx", "4xx", "5xx")


def _lines(requests: DataFrame, watermark: str) -> DataFrame:
    """Every request as a line for its duration, which carries the measures, and one for its
    visitor."""
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("int")
    kinds = F.array(
        F.struct(F.lit(1).alias("counts"), no_text.alias("visitor"), F.col("duration_ms").alias("duration")),
        F.struct(
            F.lit(0).alias("counts"), none_if_empty(F.col("remote_ip")).alias("visitor"), no_number.alias("duration")
        ),
    )
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.select(
        "ts", "host", "status", "status_class", "response_bytes", "request_bytes", micros(F.col("ts")).alias("at_us"),
        F.inline(kinds),
    )


def _sums(by_class: dict[str, Column]) -> list[Column]:
    counted = F.col("counts") == 1
    return [
        m.count_if(counted).alias("rows"),
        *[m.count_if(counted & condition).alias(f"req_{c}") for c, condition in by_class.items()],
        F.sum(F.when(counted, F.coalesce("response_bytes", F.lit(0)))).alias("bytes_out"),
        F.sum(F.when(counted, F.coalesce("request_bytes", F.lit(0)))).alias("bytes_in"),
    ]


def _merged() -> list[Column]:
    return [
        F.sum("rows").alias("req_count"),
        *[F.sum(f"req_{c}").alias(f"req_{c}") for c in _CLASSES],
        F.sum("bytes_out").alias("bytes_out"),
        F.sum("bytes_in").alias("bytes_in"),
        F.count("visitor").alias("unique_ips"),
    ]


def stream_rollup(requests: DataFrame, width: str = "1 minute", *, watermark: str = WATERMARK) -> DataFrame:
    """Traffic per tumbling window and host, given out once a window is closed (append mode)."""
    status = F.col("status")
    by_class = {
        "2xx": status.between(200, 299),
        "3xx": status.between(300, 399),
        "4xx": status.between(400, 499),
        "5xx": status >= 500,
    }
    per_value = (
        _lines(requests, watermark)
        .groupBy(F.window("ts", width), "host", "counts", "visitor", "duration")
        .agg(*_sums(by_class))
    )
    # The percentile is over counted durations: its state grows with different values only.
    shares = F.percentile("duration", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("rows"))
    per_host = per_value.groupBy("window", "host").agg(*_merged(), shares.alias("p"))
    return per_host.select(
        F.col("window.start").alias("ts"), "host", "req_count", *[f"req_{c}" for c in _CLASSES],
        "bytes_out", "bytes_in",
        *[
            m.nearest_ms(F.get("p", F.lit(i))).alias(name)
            for i, name in enumerate(("duration_p50", "duration_p95", "duration_p99"))
        ],
        "unique_ips",
    )


def _kept(
    added: DataFrame, requests_path: str, kept_path: str, checkpoint: str, at: str, reach: timedelta,
    computed: Callable[[DataFrame, datetime, datetime], DataFrame],
) -> DataStreamWriter:
    """The query that keeps a table by hour equal to the stored requests, however late a row comes.

    A request changes lines whose ``at`` lies up to ``reach`` behind it. Each micro-batch names the hours it changes; these
    alone are computed anew, from the stored requests of these hours and of ``reach`` in front of them.
    """
    spark = added.sparkSession
    hour, one = F.col("__hour"), timedelta(hours=1)

    def of(column: str) -> Column:
        return F.date_trunc("hour", column).cast("timestamp_ntz")

    def correct(batch: DataFrame, batch_id: int) -> None:
        ts = F.col("ts").cast("timestamp_ntz")
        span = F.sequence(F.date_trunc("hour", ts), F.date_trunc("hour", ts + reach), F.lit(one)).cast("array<timestamp_ntz>")
        hours = batch.filter("ts IS NOT NULL").select(F.explode(span).alias("__hour")).distinct()
        first, last = hours.agg(F.min("__hour"), F.max("__hour")).first()
        if first is None:
            return
        # The hours in which requests stand that count for a changed hour.
        needed = hours.select(F.explode(F.sequence(F.date_trunc("hour", hour - reach), F.date_trunc("hour", hour), F.lit(one))
                                        .cast("array<timestamp_ntz>")).alias("__hour")).distinct()
        stored = spark.read.parquet(requests_path)
        near = stored.filter(
            (F.col("ts") >= instant(stored, first - reach)) & (F.col("ts") < instant(stored, last + one))
            & on_days(stored, first - reach, last + one)
        )
        touched = near.withColumn("__hour", of("ts")).join(needed, "__hour", "left_semi").drop("__hour")
        found = computed(touched, first, last + one).withColumn("__hour", of(at)).join(hours, "__hour", "left_semi")
        (
            found.withColumns({"date": F.to_date("__hour"), "hour": F.hour("__hour")}).drop("__hour")
            .hint("rebalance", "date", "hour")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("date", "hour").parquet(kept_path)
        )

    return added.writeStream.foreachBatch(correct).option("checkpointLocation", checkpoint)


def keep_rollup(added: DataFrame, requests_path: str, rollup_path: str, checkpoint: str) -> DataStreamWriter:
    """The query that keeps a rollup by minute and host equal to the stored requests, however late a row comes.

    ``added`` is the stored table ``requests_path`` (by day) read as a stream. Each micro-batch names the hours it adds to; these
    alone are computed anew from all stored requests and replace their folders, so a replay changes nothing. Readers of
    an hour that is being replaced may briefly find it missing, as with any overwritten folder.
    """
    return _kept(added, requests_path, rollup_path, checkpoint, "ts", timedelta(0), rollup_minutely)


def keep_live_metrics(
    added: DataFrame, requests_path: str, live_path: str, checkpoint: str, scratch: str, *,
    seconds: int = WINDOW_SECONDS, step: int = 1,
) -> DataStreamWriter:
    """The query that keeps live metrics of every sliding window equal to the stored requests, however late a row comes.

    Nothing is held as state and no request is copied to the windows that cover it: a micro-batch's hours, and the window's
    width in front of them, are read again and their windows followed as changes per slot (``live.live_metrics``). Windows
    are given out as soon as they have a request, and corrected until the next one comes. The other arguments are those of
    ``keep_rollup``; ``scratch`` is a folder of this query that all executors share, for the slots of one micro-batch.
    """
    return _kept(
        added, requests_path, live_path, checkpoint, "window_end", timedelta(seconds=seconds),
        lambda requests, start, end: live_metrics(requests, seconds=seconds, step=step, folder=scratch),
    )


def _upper_median(counted: Column) -> Column:
    """The upper median of sorted (duration, rows) pairs."""
    total = F.aggregate(counted, F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x["rows"])
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("found"))

    def step(state: Column, x: Column) -> Column:
        seen = state["seen"] + x["rows"]
        hit = F.when(seen > F.floor(total / 2), x["duration"])
        return F.struct(seen.alias("seen"), F.coalesce(state["found"], hit).alias("found"))

    return F.aggregate(counted, start, step, lambda state: state["found"])


def stream_live_metrics(
    requests: DataFrame, *, seconds: int = WINDOW_SECONDS, step: int = 1, watermark: str = WATERMARK
) -> DataFrame:
    """Live metrics of every sliding window, given out once it is closed (append mode)."""
    by_class = {c: F.col("status_class") == c for c in _CLASSES}
    window = F.window("ts", f"{seconds} seconds", f"{step} seconds")
    edges = [F.max("at_us").alias("last_us"), F.max(-F.col("at_us")).alias("minus_first_us")]
    per_value = (
        _lines(requests, watermark)
        .groupBy(window, "counts", "visitor", "duration")
        .agg(*_sums(by_class), *edges)
    )
    # At most one pair per different duration of the window.
    pairs = F.collect_list(F.when(F.col("duration").isNotNull(), F.struct("duration", "rows")))
    per_window = per_value.groupBy("window").agg(
        *_merged(), F.max("last_us").alias("last_us"), F.max("minus_first_us").alias("minus_first_us"),
        F.array_sort(pairs).alias("pairs"),
    )
    summary = per_window.withColumns({"p50": _upper_median(F.col("pairs")), "window_end": F.col("window.end")})
    return rates(summary, ["window_end"], seconds)
